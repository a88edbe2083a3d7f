"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gatefold.llm import decontamination, linededup, minhash, packing, quality as classifier, scratch, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored like others; repeated rows fare alike;
    without labels of both kinds the score is their rate. An empty table stays empty."""
    scratch.lean(spark)
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model, cut=classifier.CUT, above=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those that had no others go. Null texts stay, null ids come last, ties
    go by the text's hash; rows of one id and text are one document and stay alike. An empty table stays empty."""
    return linededup.cleaned(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group. Texts without words, null ones too, are near only to their equals;
    of rows with one id and text one stays. An empty table stays empty."""
    return minhash.kept(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item. Null and empty texts hold none; repeated rows fare alike; items without
    words or id are none. An empty table stays empty."""
    scratch.lean(spark)
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences. A null text is an empty one, of the end token alone; repeated rows are documents of
    their own. An empty table has no pieces."""
    return packing.packed(docs)
