"""Running aggregates over a whole table in one order, without a window that brings the table into one task.

Rows are dealt out by ranges of the order and each range is scanned by its own task; the ranges' totals, one row for each
range, are scanned in turn and carried into the ranges. One shuffle, two passes, and no task sees more than its range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.sources import shared

#: By name: numpy's operation, and what it makes of nothing.
HOW = {"sum": (np.add, 0, 0.0), "min": (np.minimum, np.iinfo(np.int64).max, np.inf), "max": (np.maximum, np.iinfo(np.int64).min, -np.inf), "xor": (np.bitwise_xor, 0, None)}


def _merged(how: str, a: Column, b: Column) -> Column:
    """Of two totals, either of which may be null."""
    if how in ("min", "max"):
        return F.least(a, b) if how == "min" else F.greatest(a, b)
    return F.coalesce((a + b) if how == "sum" else a.bitwiseXOR(b), a, b)


def _total(how: str, c: Column) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "xor": F.bit_xor}[how](c)


def scanned(df: DataFrame, order: list[str], value: str, how: str, before: str = "before", running: str = "running", parts: int | None = None) -> DataFrame:
    """``df`` with the aggregate of ``value`` over all earlier rows, and over those and the row itself. ``how``: sum, min, max or
    xor; fractions become doubles, all else longs.

    Rows that are equal in every column of the order follow each other as they happen to, so the order should tell rows
    apart. Null values count for nothing; before the first value the aggregate is null. Nulls of the order come first. The
    result reads a stored table; ranges are those of Spark's sample, so one value of the order stays in one range."""
    fraction = isinstance(df.schema[value].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    kind, op, nothing = T.DoubleType() if fraction else T.LongType(), HOW[how][0], HOW[how][2 if fraction else 1]
    given = df.withColumn("_value", F.col(value).cast(kind))
    dealt = given.repartitionByRange(parts, *order) if parts else given.repartitionByRange(*order)
    shape = T.StructType([*given.schema.fields, T.StructField("_before", kind), T.StructField("_running", kind), T.StructField("_range", T.IntegerType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, any_yet = nothing, False
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            valid = np.asarray(own.is_valid())
            x = np.where(valid, np.asarray(own.fill_null(0)), nothing).astype(np.float64 if fraction else np.int64)
            total = op.accumulate(np.concatenate(([carried], x)).astype(x.dtype))
            seen = np.logical_or.accumulate(np.concatenate(([any_yet], valid)))
            carried, any_yet = total[-1], bool(seen[-1])
            cols = [pa.array(total[:-1], mask=~seen[:-1]), pa.array(total[1:], mask=~seen[1:]), pa.array(np.full(batch.num_rows, TaskContext.get().partitionId(), np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], shape.names)

    rows = shared.stored(dealt.sortWithinPartitions(*order).mapInArrow(scan, shape))
    totals = rows.groupBy("_range").agg(_total(how, F.col("_value")).alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = totals.select(F.col("_range").alias("_r"), _total(how, F.col("_total")).over(earlier).alias("_carried"))
    joined = rows.join(F.broadcast(carried), F.col("_range") == F.col("_r"))
    return joined.select(*df.columns, _merged(how, F.col("_carried"), F.col("_before")).alias(before), _merged(how, F.col("_carried"), F.col("_running")).alias(running))


def numbered(df: DataFrame, order: list[str], out: str = "place", parts: int | None = None) -> DataFrame:
    """``df`` with the place of each row in the order, from 1."""
    return scanned(df.withColumn("_one", F.lit(1)), order, "_one", "sum", "_before_place", out, parts).drop("_one", "_before_place")
