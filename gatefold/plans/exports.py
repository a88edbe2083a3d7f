"""Queries that write grids as schematic files and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatefold.sources import datasource, shared
from gatefold.sources.schematics import FORMATS, STATES
from gatefold.vocab import CELLS, LAYER


def _grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid for each embedding: substrate, and above it a block wherever the number at that place of the vector is positive."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.when(i < LAYER, 1).when(F.get(F.col("embedding"), i % F.size("embedding")) > 0, (i * (F.col("label") + 1)) % 44).otherwise(0))
    hexed = F.array_join(F.transform(cells, lambda t: F.lpad(F.hex(t), 2, "0")), "")
    return vectors.select(F.concat(F.lit("vector/"), "vec_id").alias("name"), F.unhex(hexed).alias("tokens"))


def b_schematic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grid through files of both formats: how many states, how many cells above the substrate, all states as read."""
    datasource.register(spark)
    grids, top = _grids(spark, sf_dir), shared.new_path(spark)
    parts = []
    for form in FORMATS:
        grids.write.format("schematic").option("form", form).mode("append").save(f"{top}/{form}")
        parts.append(spark.read.format("schematic").option("form", form).load(f"{top}/{form}").withColumn("form", F.lit(form)))
    air = F.lit(STATES[0])
    return parts[0].unionByName(parts[1]).select(
        "name", "form", "width", "height", "length", F.size(F.array_distinct("states")).alias("n_states"),
        F.size(F.filter(F.slice("states", LAYER + 1, CELLS), lambda s: s != air)).alias("blocks"), F.md5(F.array_join("states", "\n")).alias("digest"),
    )


QUERIES = {"b_schematic_files": b_schematic_files}

_STATES = "[" + ", ".join(f"'{s}'" for s in STATES[:44]) + "]"
ORACLE_SQL = {
    "b_schematic_files": f"""
WITH g AS (SELECT vec_id, list_transform(range({CELLS}), lambda i: {_STATES}[1 + CASE WHEN i < {LAYER} THEN 1 WHEN embedding[1 + i % len(embedding)] > 0 THEN (i * (label + 1)) % 44 ELSE 0 END]) AS states FROM embeddings)
SELECT 'vector/' || vec_id AS name, form, 16 AS width, 6 AS height, 16 AS length, len(list_distinct(states))::INT AS n_states,
  len(list_filter(states[{LAYER + 1}:], lambda s: s <> '{STATES[0]}'))::INT AS blocks, md5(array_to_string(states, chr(10))) AS digest FROM g, (VALUES ('schem'), ('litematic')) AS f(form)""",
}
