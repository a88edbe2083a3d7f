"""Streams into tables: each micro-batch is one partition of a Parquet table, named by its number.

A batch that runs again, after a failure or by hand, replaces its own partition and nothing else, so the table is the same
however often a batch was repeated. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.sources import shared

BATCH = "_batch"


def put(df: DataFrame, path: str, batch: int) -> None:
    """The rows of one batch, in place of what it wrote before."""
    df.withColumn(BATCH, F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows with their batch; no rows where no batch has written yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    shape = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path)


def run(df: DataFrame, mode: str, path: str, state: str, batch: Callable[[DataFrame, int], DataFrame] | None = None, settings: dict[str, str] | None = None) -> None:
    """Runs a stream over what is there now into the table at ``path``. ``state`` is its checkpoint: with the same one the
    next run goes on where this one ended. ``batch`` turns a micro-batch into the rows to write; ``settings`` hold for this
    stream."""
    spark = df.sparkSession

    def write(rows: DataFrame, number: int) -> None:
        put(batch(rows, number) if batch else rows, path, number)

    before = {k: spark.conf.get(k) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def result(df: DataFrame, mode: str, keys: list[str] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream into a new table and returns its result: all rows appended, the last complete result, or for updates the
    last row of each key."""
    spark = df.sparkSession
    path = shared.new_path(spark)
    run(df, mode, path, f"{path}-state", settings=settings)
    rows = table(spark, path, df.schema)
    if mode == "append":
        return rows.drop(BATCH)
    if mode == "complete":
        last = rows.agg(F.max(BATCH).alias("_last"))  # one row
        return rows.join(F.broadcast(last), F.col(BATCH) == F.col("_last")).drop(BATCH, "_last")
    return last_of(rows, keys)


def last_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the latest batch of each key."""
    own = [c for c in rows.columns if c != BATCH]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*own), BATCH).alias("_row")).select("_row.*")
