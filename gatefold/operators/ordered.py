"""Operators over ordered rows: bursts, islands, gaps, as-of and range joins, masks, histograms, joined text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatefold.operators.scan import scanned


def seconds(ts: str | Column) -> Column:
    """Whole seconds of a timestamp, with or without a zone."""
    return F.unix_seconds((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def bursts(df: DataFrame, key: str, ts: str, span: int, more_than: int) -> DataFrame:
    """Rows at which a key has more than so many rows in the trailing span of seconds."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-span * 1_000_000, 0)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") > more_than).drop(ts)


def since_first(df: DataFrame, key: Sequence[str], order: Sequence[str], ts: str) -> DataFrame:
    """Seconds since the key's first row: a period where a state comes back."""
    first = df.groupBy(*key).agg(F.min(ts).alias("_first"))
    return df.join(first, list(key)).select("event_id", (seconds(ts) - seconds("_first")).alias("period"))


def islands(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """Runs of rows with an unchanged value."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("_c", changed).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def largest_gap(df: DataFrame, key: str, order: Sequence[str], ts: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_g", seconds(ts) - seconds(F.lag(ts).over(w))).groupBy(key).agg(F.max("_g").alias("max_gap"))


def bit_mask(df: DataFrame, key: str, on: Column, bit: Column) -> DataFrame:
    """The bits that are on, by key."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    return df.groupBy(key).agg(F.bit_or(F.when(on, one).otherwise(F.lit(0).cast("long"))).alias("mask"))


def unpack_mask(df: DataFrame, key: str, mask: str, bit: str) -> DataFrame:
    """A row for each bit that is on."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("shiftright", F.col(mask), k).bitwiseAND(F.lit(1).cast("long")) == 1)
    return df.select(key, F.explode(bits).alias(bit))


def histogram(df: DataFrame, kind: str, *key: str) -> DataFrame:
    """kind=count pairs in the order of kinds, by key or in all."""
    pairs = df.groupBy(*key, kind).agg(F.count(F.lit(1)).alias("n"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(kind, "n"))), lambda s: F.concat(s[kind], F.lit("="), s["n"].cast("string")))
    return pairs.groupBy(*key).agg(F.concat_ws(";", listed).alias("histogram"))


def by_first_appearance(df: DataFrame, kind: str, order: str) -> DataFrame:
    """Kinds numbered from 0 by where they first appear; the window sees one row for each kind."""
    first = df.groupBy(kind).agg(F.min(order).alias("_first"))
    return first.select(kind, (F.row_number().over(Window.orderBy("_first")) - 1).cast("long").alias("number"))


def joined_text(df: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """Lines of each key, in order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("turns"), F.concat_ws("\n", F.transform(rows, lambda r: r["line"])).alias("transcript"))


def corrupt(df: DataFrame, key: str, flags: str, n: int) -> DataFrame:
    """Flags of each row turned at n places, chosen by a hash of key and place; as text of 0 and 1."""
    order = F.slice(F.array_sort(F.transform(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: F.struct(F.md5(F.concat(F.col(key).cast("string"), F.lit(":"), i.cast("string")).cast("binary")).alias("h"), i.alias("i")))), 1, n)
    chosen = F.transform(order, lambda s: s["i"])
    bits = F.transform(F.col(flags), lambda v, i: F.when(v != F.array_contains(F.col("_chosen"), i), "1").otherwise("0"))
    return df.withColumn("_chosen", chosen).select(key, F.concat_ws("", bits).alias("bits"))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, ident: str, name: str) -> DataFrame:
    """For each left row the last right row of its key that is no later.

    One pass over both sides in time order: a union and a running last value, no pairs."""
    a = left.select(key, ts, F.col(ident).alias("_left"), F.lit(None).cast("long").alias("_right"), F.lit(1).alias("_side"))
    b = right.select(key, ts, F.lit(None).cast("long").alias("_left"), F.col(ident).alias("_right"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(ts, "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(name, F.last("_right", ignorenulls=True).over(w)).filter("_side = 1").select(F.col("_left").alias(ident), name)


def within(left: DataFrame, right: DataFrame, key: str, ts: str, ident: str, span: int) -> DataFrame:
    """Pairs of one key in which the right row comes at most ``span`` seconds after the left one.

    Time is cut into buckets of that span; a left row meets its own bucket and the next, so it is an equi-join."""
    def bucket(c: str) -> Column:
        return F.floor(seconds(c) / span)

    a = left.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(ident).alias("a"), F.explode(F.array(bucket(ts), bucket(ts) + 1)).alias("_b"))
    b = right.select(F.col(key).alias("_k"), F.col(ts).alias("_u"), F.col(ident).alias("b"), bucket(ts).alias("_b"))
    near = (F.col("_u") > F.col("_t")) & (F.col("_u") <= F.col("_t") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(span)))
    return a.join(b, ["_k", "_b"]).filter(near & (F.col("a") != F.col("b"))).select("a", "b")


def recurrence(df: DataFrame, key: str, order: list[str], component: str, value: str, parts: int | None = None) -> DataFrame:
    """Of each key the first row after which its whole state is one it had been in before: key, place and since (rows of the
    key up to the two, from 1), period.

    A row sets one component of its key's state to a value. The state's fingerprint is the exclusive or of a hash of each
    component with its value, so a row changes it by two hashes, and all fingerprints are one running aggregate; it is
    scanned over ranges of (key, order), so that a key of any size is shared out. States of equal 64-bit fingerprints are
    taken as equal. A null value or component is one like others; keys whose state never comes back have no row."""
    was = Window.partitionBy(key, component).orderBy(*order)
    first = F.row_number().over(was) == 1
    now = F.xxhash64(component, F.col(value).isNull(), value)
    changed = df.withColumn("_now", now).withColumn("_delta", F.when(first, F.col("_now")).otherwise(F.col("_now").bitwiseXOR(F.lag("_now").over(was)))).withColumn("_one", F.lit(1))
    marked = scanned(scanned(changed.select(key, *order, "_delta", "_one"), [key, *order], "_delta", "xor", "_x0", "_x", parts), [key, *order], "_one", "sum", "_n0", "_n", parts)
    base = marked.groupBy(key).agg(F.min_by(F.struct(F.coalesce("_x0", F.lit(0)).alias("x"), F.coalesce("_n0", F.lit(0)).alias("n")), "_n").alias("_base")).withColumnRenamed(key, "_key")
    states = marked.join(base, F.col(key).eqNullSafe(F.col("_key"))).select(key, F.col("_x").bitwiseXOR(F.col("_base.x")).alias("_state"), (F.col("_n") - F.col("_base.n")).alias("place"))
    again = states.withColumn("since", F.lag("place").over(Window.partitionBy(key, "_state").orderBy("place"))).filter("since IS NOT NULL")
    return again.groupBy(key).agg(F.min_by(F.struct("place", "since"), "place").alias("_r")).select(key, "_r.place", "_r.since", (F.col("_r.place") - F.col("_r.since")).alias("period"))
