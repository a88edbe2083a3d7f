"""Scores of candidates: pass@k, rates, ratios to a reference, diversity, novelty, accuracy, skyline, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatefold.operators.scan import scanned


def pass_at_k(df: DataFrame, group: str, order: list[str], passed: Column, ks: tuple[int, ...] = (1, 8, 64)) -> DataFrame:
    """One row: the share of groups with a pass among their first k rows."""
    ranked = df.withColumn("idx", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    per = ranked.groupBy(group).agg(*[F.max((passed & (F.col("idx") < k)).cast("int")).alias(f"p{k}") for k in ks])
    return per.agg(*[F.round(F.coalesce(F.avg(f"p{k}"), F.lit(0.0)), 4).alias(f"pass_at_{k}") for k in ks])


def rates(df: DataFrame, kind: str) -> DataFrame:
    """The share of each kind."""
    per = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return per.select(kind, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("rate"))


def best(df: DataFrame, group: str, order: list[str], keep: list[str]) -> DataFrame:
    """The first row of each group in the order; ties go by the later columns of the order."""
    return df.groupBy(group).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("b")).select(group, "b.*")


def keep_per_group(df: DataFrame, group: str, distinct: list[str], order: list[str], n: int) -> DataFrame:
    """The n best rows of each group after dropping repeated ones; the first of equal rows counts."""
    once = df.groupBy(group, *distinct).agg(*[F.min(c).alias(c) for c in order if c not in distinct])
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("place") <= n)


def closest_miss(df: DataFrame, group: str, wrong: str, order: list[str], keep: list[str]) -> DataFrame:
    """Of each group the row with the fewest wrong answers above none, if that is just one."""
    return df.filter(F.col(wrong) > 0).groupBy(group).agg(F.min(wrong).alias("least"), F.min_by(F.struct(*keep), F.struct(wrong, *order)).alias("b")).filter("least = 1").select(group, "b.*")


def mean_ratio(values: DataFrame, reference: DataFrame, key: str, value: str, base: str) -> DataFrame:
    """The mean of value/base where both exist and the base isn't zero; null without such rows."""
    return values.join(reference, key).filter(F.col(base) > 0).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(value) / F.col(base)), 4).alias("mean_ratio"))


def diversity(df: DataFrame, group: str, item: str) -> DataFrame:
    """The mean number of distinct items of a group."""
    return df.groupBy(group).agg(F.count_distinct(item).alias("d")).agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg("d"), 3).alias("diversity"))


def novelty(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The share of rows, repeats counted, whose key is not known; 0 without rows."""
    seen = known.select(F.col(key).alias("_k")).distinct().withColumn("_seen", F.lit(1))
    return df.join(seen, F.col(key) == F.col("_k"), "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_seen").isNull()).alias("n_new"), F.round(F.coalesce(F.avg(F.col("_seen").isNull().cast("int")), F.lit(0.0)), 4).alias("novelty"))


def per_class_accuracy(df: DataFrame, target: str, predicted: str) -> DataFrame:
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(target) == F.col(predicted)).cast("int")), 4).alias("accuracy"))


def class_weights(df: DataFrame, target: str, most: float = 10.0) -> DataFrame:
    """Inverse frequencies total/(classes*count), capped."""
    per = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return per.select(target, "n", F.round(F.least(F.lit(most), F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))), 6).alias("weight"))


def skyline(df: DataFrame, a: str, b: str, parts: int | None = None) -> DataFrame:
    """(a, b) pairs, numbers, that no other pair equals or beats in both. The least b of each a, kept where it is under that of
    every smaller a: an aggregate and a running minimum in place of a quadratic anti-join. Null numbers are never in it."""
    per = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a).agg(F.min(b).alias(b))
    return scanned(per, [a], b, "min", "_before", "_least", parts).filter(F.col("_before").isNull() | (F.col(b) < F.col("_before"))).select(a, b)


def collapse(rounds: DataFrame, order: str, score: str, variety: str, fresh: str, unstable: str) -> DataFrame:
    """An alarm where over three rounds the score rose while variety or freshness fell, or instability doubled."""
    w = Window.orderBy(order)
    first = {c: F.lag(c, 2).over(w) for c in (score, variety, fresh, unstable)}
    fell = (F.col(variety) < 0.7 * first[variety]) | (F.col(fresh) < 0.5 * first[fresh])
    alarm = F.when((F.col(score) > first[score]) & fell, "collapsing").when(F.col(unstable) > 2 * first[unstable] + 0.01, "unstable")
    return rounds.select(order, score, variety, fresh, unstable, alarm.alias("alarm"))


def curriculum(rounds: DataFrame, order: str, score: str, threshold: float, last: int = 4) -> DataFrame:
    """The stage each round ran at: how many earlier rounds reached the threshold, at most ``last``."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rounds.select(order, score, F.least(F.lit(last), F.coalesce(F.sum((F.col(score) >= threshold).cast("int")).over(before), F.lit(0))).cast("int").alias("stage"))


def agreement(pairs: DataFrame, expected: str, observed: str) -> DataFrame:
    """Share of observed rows that agree; unobserved ones don't count; 0 if none was observed."""
    return pairs.agg(F.count(F.lit(1)).alias("cases"), F.count(observed).alias("checked"), F.count_if(F.col(expected) == F.col(observed)).alias("agreed"), F.round(F.coalesce(F.avg((F.col(expected) == F.col(observed)).cast("int")), F.lit(0.0)), 5).alias("agreement"))
