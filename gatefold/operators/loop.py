"""Self-improvement rounds over verdict tables: what is accepted, what needs repair, the report, carried state.

A verdict table has a row for each candidate: spec_hash, cand_idx, tokens, kind, blocks, latency_rt, n_wrong, constraint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatefold.vocab import AIR, CELLS, LAYER, SOLID, SX, SZ, TORCH, WIRE


def accepted(verdicts: DataFrame, keep: int = 4) -> DataFrame:
    """Of each spec the ``keep`` best passing layouts, by blocks, then latency; a repeated layout counts once."""
    once = verdicts.filter("kind = 'pass'").groupBy("spec_hash", "tokens").agg(F.min_by(F.struct("cand_idx", "blocks", "latency_rt"), "cand_idx").alias("v")).select("spec_hash", "tokens", "v.*")
    w = Window.partitionBy("spec_hash").orderBy("blocks", "latency_rt", "cand_idx")
    return once.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)


def repairs(verdicts: DataFrame, reference: DataFrame) -> DataFrame:
    """The closest miss of each spec that has none passing, if one row is wrong, beside the reference layout of the spec."""
    solved = verdicts.filter("kind = 'pass'").select("spec_hash").distinct()
    misses = verdicts.filter("kind = 'fail' AND constraint IS NULL AND n_wrong > 0").join(solved, "spec_hash", "left_anti")
    near = misses.groupBy("spec_hash").agg(F.min("n_wrong").alias("least"), F.min_by("tokens", F.struct("n_wrong", "cand_idx")).alias("tokens")).filter("least = 1")
    return near.select("spec_hash", "tokens").join(reference.select("spec_hash", F.col("tokens").alias("goal")), "spec_hash")


def updated_reference(reference: DataFrame, best: DataFrame, fixed: bool = False) -> DataFrame:
    """The best layout known of each spec. A newcomer replaces one that has more cells, by the old count that includes the
    substrate; ``fixed`` leaves it out."""
    size = F.size(F.filter("tokens", lambda t: t != 0)) - (LAYER if fixed else 0)
    old = reference.select("spec_hash", F.col("tokens").alias("old"), size.alias("old_size"))
    both = old.join(best.select("spec_hash", F.col("tokens").alias("new"), F.col("blocks").alias("new_size")), "spec_hash", "full")
    return both.select("spec_hash", F.when(F.col("old").isNull() | (F.col("new_size") < F.col("old_size")), F.col("new")).otherwise(F.col("old")).alias("tokens"))


def known_layouts(known: DataFrame, more: DataFrame) -> DataFrame:
    return known.select("tokens").union(more.select("tokens")).distinct()


def round_report(specs: DataFrame, verdicts: DataFrame, known: DataFrame, keep: int = 4) -> DataFrame:
    """One row. Pass rates are shares of all specs, those without candidates too; other rates are shares of candidates;
    novelty is the share of accepted layouts that were not known."""
    took = accepted(verdicts, keep)
    a = specs.agg(F.count(F.lit(1)).alias("specs"))
    b = verdicts.agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct(F.when((F.col("cand_idx") == 0) & (F.col("kind") == "pass"), F.col("spec_hash"))).alias("at_1"), F.count_distinct(F.when(F.col("kind") == "pass", F.col("spec_hash"))).alias("at_k"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("unstable", "malformed", "fail")])
    new = took.join(known.select("tokens").distinct().withColumn("was", F.lit(1)), "tokens", "left")
    c = new.agg(F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("was").isNull()).alias("novel"), F.avg("blocks").alias("blocks"), F.avg("latency_rt").alias("latency"))
    d = verdicts.filter("kind = 'pass'").groupBy("spec_hash").agg(F.count_distinct("tokens").alias("n")).agg(F.avg("n").alias("layouts"))

    def ratio(x: str, y: str) -> Column:
        return F.coalesce(F.round(F.try_divide(F.col(x), F.col(y)), 4), F.lit(0.0))

    one = a.join(b).join(c).join(d)  # each has one row
    return one.select(
        "specs", "candidates", ratio("at_1", "specs").alias("pass_at_1"), ratio("at_k", "specs").alias("pass_at_k"), "accepted", F.coalesce(F.round("blocks", 2), F.lit(0.0)).alias("mean_blocks"), F.coalesce(F.round("latency", 2), F.lit(0.0)).alias("mean_latency_rt"),
        F.coalesce(F.round("layouts", 2), F.lit(0.0)).alias("layouts_per_spec"), ratio("novel", "accepted").alias("novelty"), ratio("unstable", "candidates").alias("unstable_rate"), ratio("malformed", "candidates").alias("malformed_rate"), ratio("fail", "candidates").alias("fail_rate"),
    )


def corrupted(df: DataFrame, seed: str, blocks: int = 4) -> DataFrame:
    """(id, tokens, input_z, output_z) with up to so many cells damaged, above the substrate and away from ports: seven in
    ten become air, the others wire, solid or a floor torch. Places come from a hash, so a run can be repeated."""
    port = F.concat(F.flatten(F.transform("input_z", lambda z: F.array((SZ + z) * SX, (SZ + z) * SX + 1))), F.flatten(F.transform("output_z", lambda z: F.array((SZ + z) * SX + SX - 1, (SZ + z) * SX + SX - 2))))
    free = F.filter(F.sequence(F.lit(LAYER), F.lit(CELLS - 1)), lambda i: (F.get("tokens", i) != AIR) & ~F.array_contains(F.col("_ports"), i))
    drawn = F.slice(F.array_sort(F.transform(free, lambda i: F.struct(F.xxhash64(F.col("id"), F.lit(seed), i).alias("h"), i.alias("i")))), 1, blocks)

    def damage(s: Column) -> Column:
        p = F.pmod(s["h"], F.lit(1000))
        return F.when(p < 700, AIR).when(p < 800, WIRE).when(p < 900, SOLID).otherwise(TORCH)

    marked = df.withColumn("_ports", port).withColumn("_hit", drawn)
    changes = F.map_from_entries(F.transform("_hit", lambda s: F.struct(s["i"].alias("k"), damage(s).alias("v"))))
    out = F.transform("tokens", lambda t, i: F.coalesce(F.try_element_at(F.col("_changes"), i), t))
    return marked.withColumn("_changes", changes).select("id", out.alias("tokens"), F.array_sort(F.transform("_hit", lambda s: s["i"])).alias("changed"))
