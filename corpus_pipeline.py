"""The corpus pipeline: documents through the stages of STAGES, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gatefold.llm import scratch, stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", stages.quality),
    ("line dedup", stages.lines),
    ("minhash near-dedup", stages.near_copies),
    ("benchmark decontamination", stages.leaks),
    ("best-fit packing", stages.pack),
]

#: Trained weights and hashes decide here, which SQL can't express; the near-duplicate stage is tested against brute force, the
#: others against their operators' own results, which have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; nulls, repeated rows and empty tables are as each stage says, and nothing is lost between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.stored(stage(spark, docs, sf_dir))
    return docs
