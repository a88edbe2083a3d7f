"""Plug-in points: Arrow kernels over batches, and table functions that give several rows for one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norms(df: DataFrame, ident: str, vector: str) -> DataFrame:
    """Euclidean norms by a numpy kernel over each Arrow batch. Empty and null vectors have norm 0."""
    rows = df.select(ident, vector)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(np.concatenate(([0], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            sums = np.concatenate(([0.0], np.cumsum(np.square(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.sqrt(np.maximum(0, sums[ends[1:]] - sums[ends[:-1]])), 4))], [ident, "norm"])

    return rows.mapInArrow(work, T.StructType([rows.schema[ident], T.StructField("norm", T.DoubleType())]))


def tagged(df: DataFrame, column: str, tags: dict[str, str]) -> DataFrame:
    """Each row once for its value and once for the value's tag, if it has one, as ``item``."""
    known = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    return df.withColumn("item", F.explode(F.array_compact(F.array(F.col(column), F.try_element_at(known, F.col(column))))))
