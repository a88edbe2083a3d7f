"""Rounds as micro-batches: a log with a report of each round, and a cache of accepted cases that a run resumes from.

Both tables may be written again by the same batch, by a restart with its checkpoint, or by a run from the start, without
gaining a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.operators.corpus import first_occurrence, unseen
from gatefold.sources import shared
from gatefold.streaming import tables


def report(rows: DataFrame, group: str, spec: str, passed: Column, score: str) -> DataFrame:
    """Of each group: candidates, distinct specs, accepted candidates, the best score (null if all are). A null group is one."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct(spec).alias("specs"), F.count_if(passed).alias("accepted"), F.max(F.col(score).cast("double")).alias("best"))


def log_rounds(rows: DataFrame, path: str, state: str, group: str, spec: str, passed: Column, score: str) -> None:
    """Each micro-batch of the stream is a round; its report replaces the one that it wrote before, if it did."""
    tables.run(rows, "append", path, state, lambda own, _: report(own, group, spec, passed, score))


def round_log(spark: SparkSession, path: str) -> DataFrame:
    """round and its reports, as the files have them."""
    log = spark.read.parquet(path)
    return log.select(F.col(tables.BATCH).cast("long").alias("round"), *[c for c in log.columns if c != tables.BATCH])


def cache_cases(cases: DataFrame, path: str, state: str, name: str, order: str) -> None:
    """Keeps of each name the first case, by ``order``, of the first micro-batch that has it.

    A batch adds the names that other batches have not cached. What it cached itself in an earlier attempt it writes again,
    so a repeated batch changes nothing; where another checkpoint's batch had the same number, its rows stay beside the new
    ones. Cases without a name are left out."""
    spark = cases.sparkSession

    def accept(own: DataFrame, number: int) -> DataFrame:
        before = tables.table(spark, path, own.schema)
        others = before.filter(F.col(tables.BATCH) != number)
        fresh = unseen(first_occurrence(own.filter(F.col(name).isNotNull()), name, order), others, name, name)
        mine = before.filter(F.col(tables.BATCH) == number).select(*own.columns)
        return shared.stored(mine.unionByName(unseen(fresh, mine, name, name))) if _writes_over(before, number) else fresh

    tables.run(cases, "append", path, state, accept)


def _writes_over(before: DataFrame, number: int) -> bool:
    """Whether the batch's partition is there, so that what it holds must be read before it is replaced."""
    return bool(before.filter(F.col(tables.BATCH) == number).limit(1).count())


def cached_cases(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return tables.table(spark, path, schema)
