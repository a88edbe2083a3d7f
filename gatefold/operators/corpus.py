"""Building a corpus: first occurrences, hold-outs, splits without leakage, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatefold.operators.scan import numbered


def canonical_key(text: str | Column) -> Column:
    """MD5 of the text, lower-cased, with runs of white space as one blank: equal keys are equal content."""
    c = F.col(text) if isinstance(text, str) else text
    return F.md5(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")))


def first_occurrence(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the least ``order`` of each key, by a partial aggregate rather than a window, so that a frequent key is
    reduced before it is shuffled."""
    return df.groupBy(key).agg(F.min_by(F.struct(*df.columns), order).alias("first_row")).select("first_row.*")


def unseen(df: DataFrame, known: DataFrame, key: str, known_key: str) -> DataFrame:
    """Rows whose key no known row has."""
    return df.join(known.select(F.col(known_key).alias("_known")), F.col(key) == F.col("_known"), "left_anti")


def whole_bucket(bucket: Column, held: Sequence[int], modulus: int) -> Column:
    """Splits by whole buckets: 'test' for those of ``held``, 'val' for the next number, else 'train'."""
    part = F.pmod(bucket, F.lit(modulus))
    return F.when(part.isin(*held), "test").when(part == (max(held) + 1) % modulus, "val").otherwise("train")


def report(df: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """Per split: rows, distinct keys, mean size, yield."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"), F.round(F.avg(size), 4).alias("mean_size"), F.max(size).alias("max_size"))


def ordered_splits(candidates: DataFrame, plan: Sequence[tuple[str, int]], key: str, order: str, split: str) -> DataFrame:
    """Picks the first n keys of each split in the plan's order; a key picked by an earlier split is skipped, one that an
    earlier split merely listed is not."""
    taken: DataFrame | None = None
    for name, n in plan:
        own = first_occurrence(candidates.filter(F.col(split) == name), key, order)
        if taken is not None:
            own = unseen(own, taken, key, key)
        own = own.orderBy(order).limit(n)
        taken = own if taken is None else taken.unionByName(own)
    return taken


def sample_ahead(df: DataFrame, n: int, key: Column) -> DataFrame:
    """n rows in the order of a hash: a sample without replacement that a re-run repeats."""
    return df.orderBy(key).limit(n)


def quotas(spark, plan: Sequence[tuple[str, int]], scale: float) -> DataFrame:
    """Scaled split sizes, one at least."""
    return spark.createDataFrame(list(plan), "split string, n long").select("split", F.greatest(F.lit(1), F.round(F.col("n") * F.lit(scale))).cast("long").alias("n"))


def card_lines(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """place and line of a Markdown table: its two head lines, then a line for each row, in the order; null cells are empty.
    No task has more than its range of rows."""
    head = df.sparkSession.createDataFrame([(1, "| " + " | ".join(columns) + " |"), (2, "|" + " --- |" * len(columns))], "place long, line string")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    rows = numbered(df.select(*order, line.alias("line")), list(order))
    return head.union(rows.select((F.col("place") + 2).alias("place"), "line"))


def write_card(df: DataFrame, columns: Sequence[str], order: Sequence[str], path: str) -> None:
    """The lines as text files whose names sort as their lines do."""
    card_lines(df, columns, order).repartitionByRange("place").sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def windowed_rank(df: DataFrame, partition: str, *order: Column | str) -> DataFrame:
    return df.withColumn("rank_in_group", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))
