"""Sampling to quotas with rejection: the rows of each stratum with the lowest hashes that a test accepts.

What is drawn are the rows up to a hash that counts of the hashes' leading digits find, so no task gets a stratum, however
large it or its quota is. A round draws what is still short, in view of how many were accepted so far, from
where the last one ended; the test, however dear, sees those rows alone. The sample is the same whatever the rounds were.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.operators.corpus import first_occurrence
from gatefold.sources import shared

#: What a round draws over what it expects to need, and rows a stratum's round draws at least.
SURPLUS, LEAST = 1.25, 16


class TooFew(ValueError):
    """Strata that ran out of rows before their quota was full: {stratum: (accepted, quota)}."""

    def __init__(self, short: dict):
        super().__init__("too few rows: " + ", ".join(f"{k} {a} of {q}" for k, (a, q) in sorted(short.items(), key=str)))
        self.short = short


def place(seed: str, key: str | Column) -> Column:
    """The hash that orders a stratum."""
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(seed + ":"), c.cast("string")))


#: Leading digits of a place that a stratum's rows are counted by, 65,536 counts at most.
DIGITS = 4


def lowest(df: DataFrame, stratum: str, wanted: DataFrame) -> DataFrame:
    """The rows of each stratum with the lowest places, as many as ``wanted`` (_s, _want; few rows) says; places are hashes
    without repetition.

    Counts by leading digits say where a stratum's last wanted row is. Rows before those digits are taken where they are
    read, and only rows with just those digits, one in 65,536, are put in order."""
    digits = F.substring("place", 1, DIGITS)
    counts = df.groupBy(F.col(stratum).alias("_s"), digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(wanted), "_s")
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_digits"))  # the counts of a stratum
    last = counts.withColumn("_upto", upto).filter(F.col("_upto") >= F.col("_want")).groupBy("_s").agg(F.min_by(F.struct(F.col("_digits").alias("digits"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("n")), "_digits").alias("_last"))
    ends = shared.stored(wanted.select("_s").join(last, "_s", "left"))
    rows = df.join(F.broadcast(ends), F.col(stratum) == F.col("_s"))
    whole = rows.filter(F.col("_last").isNull() | (digits < F.col("_last.digits")))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy("place"))
    some = rows.filter(digits == F.col("_last.digits")).withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_last.n"))
    return whole.select(*df.columns).union(some.select(*df.columns))


def to_quota(df: DataFrame, key: str, order: str, stratum: str, quotas: dict, accept: Callable[[DataFrame], DataFrame], seed: str = "", strict: bool = False) -> DataFrame:
    """``df``'s columns and ``place``: of each stratum the first so many distinct keys that ``accept`` keeps, in hash order.

    ``accept`` takes rows and returns those it keeps, with the same columns. Of rows of one key the first by ``order`` stands
    for it. Null keys are never drawn; strata without a quota are left out. A stratum that runs out is returned as it is, or
    raises TooFew where ``strict``. The driver holds one row for each quota."""
    spark = df.sparkSession
    if not quotas:
        return df.limit(0).withColumn("place", F.lit(None).cast("string"))
    kind = df.schema[stratum].dataType
    own = first_occurrence(df.filter(F.col(key).isNotNull()), key, order).filter(F.col(stratum).isin(*quotas))
    pool = shared.stored(own.withColumn("place", place(seed, key)))
    state = {s: {"want": max(LEAST, math.ceil(SURPLUS * q)), "after": "", "had": 0, "drawn": 0} for s, q in quotas.items() if q > 0}
    parts: list[DataFrame] = []
    got = dict.fromkeys(quotas, 0)
    while state:
        asked = spark.createDataFrame([(s, x["want"], x["after"]) for s, x in state.items()], T.StructType([T.StructField("_s", kind), T.StructField("_want", T.LongType()), T.StructField("_after", T.StringType())]))
        rows = pool.join(F.broadcast(asked), (F.col(stratum) == F.col("_s")) & (F.col("place") > F.col("_after")))
        drawn = shared.stored(lowest(rows.select(*pool.columns), stratum, asked.select("_s", "_want")))
        kept = shared.stored(accept(drawn).select(*pool.columns))
        parts.append(kept)
        ends = {r[0]: (r["n"], r["last"]) for r in drawn.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last")).collect()}
        for r in kept.groupBy(stratum).count().collect():
            got[r[0]] += r["count"]
        for s, x in list(state.items()):
            n, last = ends.get(s, (0, ""))
            x["drawn"] += n
            if n < x["want"] or got[s] >= quotas[s]:
                del state[s]
                continue
            rate = max(got[s], 0.5) / x["drawn"]
            state[s] |= {"after": last, "want": max(LEAST, min(8 * x["want"], math.ceil(SURPLUS * (quotas[s] - got[s]) / rate)))}
    if strict and (short := {s: (got[s], q) for s, q in quotas.items() if got[s] < q}):
        raise TooFew(short)
    out = parts[0] if parts else pool.limit(0)
    for more in parts[1:]:
        out = out.unionByName(more)
    return lowest(out, stratum, spark.createDataFrame([(s, q) for s, q in quotas.items() if q > 0], T.StructType([T.StructField("_s", kind), T.StructField("_want", T.LongType())])))
