"""Reading and writing corpora, caches, spec texts and grids."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatefold.vocab import CELLS

#: The fields of a corpus record, in order.
EXAMPLE = "spec_source string, spec_hash string, gates int, n_inputs int, n_outputs int, rows array<bigint>, input_z array<int>, output_z array<int>, tokens array<int>, latency_rt int, blocks int, bbox array<int>, prompts array<string>"


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE) -> DataFrame:
    """JSON Lines of corpus records. Blank lines are skipped; broken lines and missing or unknown keys raise when read."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    names = [c.split()[0] for c in schema.split(", ")]
    keys = F.json_object_keys("value")
    fits = F.array_sort(keys) == F.array(*[F.lit(n) for n in sorted(names)])
    strict = F.when(fits, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("keys of a record differ: "), F.concat_ws(",", keys))))
    return lines.select(F.from_json(strict, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_examples(df: DataFrame, path: str) -> None:
    """A folder of JSON Lines for each split."""
    df.write.partitionBy("split").option("ignoreNullFields", "false").json(path)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each text: path, title (its first comment, else the file's name), source."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    comment = F.regexp_extract("source", r"(?m)^\s*#\s*(.*?)\s*$", 1)
    return df.select("path", F.when(comment != "", comment).otherwise(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1)).alias("title"), "source")


def read_grids(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of tokens, one a line; a wrong number of them raises."""
    tokens = F.from_json("value", "array<int>")
    return spark.read.text(path).select(F.when(F.size(tokens) == CELLS, tokens).otherwise(F.raise_error(F.concat(F.lit("a grid has "), F.size(tokens).cast("string"), F.lit(" cells")))).alias("tokens"))


def read_cache(spark: SparkSession, path: str, seed: int, schema: str) -> DataFrame:
    """Cases behind a header line {"format", "seed"}; another seed raises."""
    head = json.loads(spark.read.text(path).filter(F.get_json_object("value", "$.seed").isNotNull() & F.get_json_object("value", "$.name").isNull()).first()["value"])
    if head["seed"] != seed:
        raise ValueError(f"the cache is for seed {head['seed']}")
    return spark.read.text(path).filter(F.get_json_object("value", "$.name").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")


def append_new(df: DataFrame, path: str, key: str, known: DataFrame) -> None:
    """Appends the rows whose key is not known yet: a run that is taken up again adds only what is missing."""
    df.join(known.select(key), key, "left_anti").write.mode("append").json(path)


def tokens_of(grid: str) -> Column:
    """A binary grid as an array of tokens."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(grid)), lambda i: F.conv(F.hex(F.substr(F.col(grid), i, F.lit(1))), 16, 10).cast("int"))
