"""Text hooks with a cache: a callable answers each distinct text once, ever, and a template answers where it doesn't.

Cache-aside: an anti-join finds the keys that the cache lacks, one row of each goes to the hook in batches on the executors,
and what it answers is written back before anything reads it. A fill is one partition of the cache, replaced as a whole when
it is written again; two fills that hold one key agree on the earlier one, so a race costs a call and no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatefold.operators.corpus import first_occurrence, unseen
from gatefold.sources import shared

#: Texts in, answers out, in their order; None or an empty text is no answer.
Hook = Callable[[list[str]], list[str | None]]

SCHEMA = "key string, answer string, fill long"
#: Texts that a hook gets at a time.
BATCH = 64


def cache(spark: SparkSession, path: str) -> DataFrame:
    """key, answer, fill: of each key the earliest fill; empty where nothing has been written."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], SCHEMA)
    return first_occurrence(spark.read.schema(SCHEMA).parquet(path), "key", "fill")


def misses(df: DataFrame, known: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """key and text of each distinct key that the cache lacks: the text of its first row."""
    asked = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(order).alias("_order"))
    return first_occurrence(unseen(asked, known, "key", "key"), "key", "_order").select("key", "text")


def called(asked: DataFrame, hook: Hook, batch: int = BATCH) -> DataFrame:
    """key and answer of each row of (key, text). An answer that is empty after trimming is null; a hook that returns another
    number of answers fails the task."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, batch):
                own = part.slice(at, batch)
                answers = list(hook(own.column(1).to_pylist()))
                if len(answers) != own.num_rows:
                    raise ValueError(f"{own.num_rows} texts have {len(answers)} answers")
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([a if a and a.strip() else None for a in answers], pa.string())], ["key", "answer"])

    shared.lean(asked.sparkSession)
    return asked.mapInArrow(call, "key string, answer string")


def fill(df: DataFrame, path: str, hook: Hook, key: str, text: str, order: str, number: int) -> None:
    """Asks the hook for what the cache lacks and writes it back as fill ``number``. Null answers are written too, so that a
    text without an answer isn't asked again. Running a fill again when it is complete asks and writes nothing."""
    spark = df.sparkSession
    new = called(misses(df, cache(spark, path), key, text, order), hook)
    mine = cache(spark, path).filter(F.col("fill") == number)
    if mine.limit(1).count():  # a fill of this number is there: what it lacks goes beside it
        number = cache(spark, path).agg(F.max("fill")).first()[0] + 1
    new.withColumn("fill", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fill").parquet(path)


def answered(df: DataFrame, path: str, hook: Hook, key: str, text: str, order: str, template: Column, number: int = 0, out: str = "answer") -> DataFrame:
    """``df`` with the answer to each row's key, and the template's text where there is none: without key or text, or where
    the hook gave nothing. Rows of one key get one answer; the cache is filled first."""
    fill(df, path, hook, key, text, order, number)
    known = cache(df.sparkSession, path).select(F.col("key").alias("_key"), F.col("answer").alias("_answer"))
    return df.join(known, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_answer", template)).drop("_key", "_answer")
