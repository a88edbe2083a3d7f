"""Gapless ranks within a few classes without bringing a class together: ranks within each block of rows, and the
classes' counts in earlier blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch


def with_ranks(df: DataFrame, kind: str, classes: int) -> DataFrame:
    """``df`` with ``rank``, long, from 0 within each value of the int column ``kind`` (0 to classes-1). Blocks of rows are
    numbered when they are written, so a block computed twice counts once."""
    schema = T.StructType([*df.schema.fields, T.StructField("rank_block", T.LongType()), T.StructField("rank_in_block", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(classes, np.int64)
        for batch in batches:
            own = np.asarray(batch.column(batch.schema.get_field_index(kind)))
            order = np.argsort(own, kind="stable")
            counts = np.bincount(own, minlength=classes)
            within = np.empty(len(own), np.int64)
            within[order] = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            block = pa.array(np.full(len(own), TaskContext.get().partitionId(), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, block, pa.array(within + seen[own])], [*batch.schema.names, "rank_block", "rank_in_block"])
            seen += counts

    rows = scratch.stored(df.mapInArrow(number, schema))
    counts = rows.groupBy(kind, "rank_block").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(kind).orderBy("rank_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col(kind).alias("base_kind"), F.col("rank_block").alias("base_block"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.join(base, (F.col(kind) == F.col("base_kind")) & (F.col("rank_block") == F.col("base_block")))
    return joined.select(*df.columns, (F.col("base") + F.col("rank_in_block")).alias("rank"))
