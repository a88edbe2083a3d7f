"""Attempts at specifications over rounds: bounded collection, unreadable answers, repair, what rounds carry on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatefold.operators.metrics import pass_at_k


def collected(attempts: DataFrame, group: str, order: str, item: str, count: int) -> DataFrame:
    """The first ``count`` different items of each group, in the order, as long as fewer than 3 * count + 6 repeats came before.
    Dealt out by group, rows serve both windows."""
    first = attempts.repartition(group).withColumn("_new", F.row_number().over(Window.partitionBy(group, item).orderBy(order)) == 1)
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = first.withColumn("_found", F.coalesce(F.count_if(F.col("_new")).over(before), F.lit(0))).withColumn("_missed", F.coalesce(F.count_if(~F.col("_new")).over(before), F.lit(0)))
    return counted.filter(F.col("_new") & (F.col("_found") < count) & (F.col("_missed") < 3 * count + 6)).select(group, order, item, (F.col("_found") + 1).cast("int").alias("place"))


def unreadable(answers: DataFrame, group: str, grid: Column) -> DataFrame:
    """Answers of each group and how many of them are no grid; those are counted, not dropped."""
    return answers.groupBy(group).agg(F.count(F.lit(1)).alias("answers"), F.count_if(grid.isNull()).alias("unparseable"))


def repair_success(repairs: DataFrame, group: str, order: list[str], passed: Column) -> DataFrame:
    """The share of groups whose first repair passes."""
    return pass_at_k(repairs, group, order, passed, (1,)).withColumnRenamed("pass_at_1", "repair_success")


def suites(parts: dict[str, DataFrame]) -> DataFrame:
    """Suites of cases one after the other, with the name of each."""
    out: DataFrame | None = None
    for name, df in parts.items():
        own = df.withColumn("suite", F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def noise(specs: DataFrame, key: str, seed: str, tokens: list[int], share: float = 0.08, samples: int = 1) -> DataFrame:
    """(key, sample, x, z, token): cells of random layers, between the ports' columns; each is taken with a fixed chance,
    by a hash of key, seed and place, so that a run can be repeated."""
    cells = specs.select(key, F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).select(key, "sample", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("z")).select(key, "sample", "z", F.explode(F.sequence(F.lit(2), F.lit(14))).alias("x"))
    drawn = F.pmod(F.xxhash64(key, F.lit(seed), "sample", "x", "z"), F.lit(1_000_000))
    taken = cells.withColumn("_h", drawn).filter(F.col("_h") < int(share * 1_000_000))
    return taken.select(key, "sample", "x", "z", F.get(F.array(*map(F.lit, tokens)), F.pmod(F.xxhash64("_h", "x", "z"), F.lit(len(tokens))).cast("int")).alias("token"))


def rounds(verdicts: DataFrame, known: DataFrame, keep: int, threshold: float, last: int = 4, first: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Over the rounds of (round, spec_hash, cand_idx, tokens, kind, blocks): a report of each round, all layouts known after
    the last, and the best layout of each spec.

    A round accepts the ``keep`` passing layouts of each spec with the fewest blocks, of equal layouts the first, by ``first``
    or else by blocks, then candidate; those that no earlier round knew are novel. The stage of a round is how many earlier ones passed the threshold with a first
    candidate. What a round carries over is a function of all before it, so nothing loops: a layout is novel in the round
    that first accepts it, and the best layout is the least of all accepted."""
    by = F.struct((F.struct("blocks", "cand_idx") if first is None else first).alias("first"), F.col("cand_idx"))
    once = verdicts.filter("kind = 'pass'").groupBy("round", "spec_hash", "tokens").agg(F.min("blocks").alias("blocks"), F.min_by("cand_idx", by).alias("cand_idx"))
    place = F.row_number().over(Window.partitionBy("round", "spec_hash").orderBy("blocks", "cand_idx", "tokens"))
    took = once.withColumn("place", place).filter(F.col("place") <= keep).select("round", "spec_hash", "tokens", "blocks")
    per = took.groupBy("round", "tokens").agg(F.count(F.lit(1)).alias("n"))
    begun = per.groupBy(F.col("tokens").alias("t")).agg(F.min("round").alias("since"))
    old = known.select(F.col("tokens").alias("o")).distinct()
    marked = per.join(begun, F.col("tokens") == F.col("t")).join(old, F.col("tokens") == F.col("o"), "left")
    counts = marked.groupBy(F.col("round").alias("r")).agg(F.sum("n").alias("accepted"), F.sum(F.when((F.col("since") == F.col("round")) & F.col("o").isNull(), F.col("n")).otherwise(0)).alias("novel"))
    asked = verdicts.groupBy("round").agg(F.count_distinct("spec_hash").alias("specs"), F.count_distinct(F.when((F.col("cand_idx") == 0) & (F.col("kind") == "pass"), F.col("spec_hash"))).alias("first"))
    both = asked.join(counts, F.col("round") == F.col("r"), "left").select("round", "specs", "first", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "novel")])
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)  # a row for each round
    stage = F.least(F.lit(last), F.coalesce(F.count_if(F.col("first") >= threshold * F.col("specs")).over(before), F.lit(0))).cast("int")
    best = took.groupBy("spec_hash").agg(F.min(F.struct("blocks", "tokens")).alias("b")).select("spec_hash", "b.tokens", "b.blocks")
    return both.withColumn("stage", stage), known.select("tokens").union(took.select("tokens")).distinct(), best
