"""Queries whose operators call what a user plugs in, write tables, or report on them as they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatefold.operators import candidates, corpus, hooks, observed
from gatefold.plans.tables import _STATUSES, _statuses
from gatefold.sources import shared


def _tables(spark: SparkSession, sf_dir: str):
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tagged(row, k: int) -> list[str]:
    """A sampler: an event proposes its kind, and a dear one the kind of its buyer too; errors propose nothing."""
    if row["event_type"] == "error":
        return [None]
    return [row["event_type"], *(["dear " + row["event_type"]] if row["value"] is not None and row["value"] >= 100 else [])]


def b_udtf_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _tables(spark, sf_dir)("events").select("event_id", "ts", "user_id", "event_type", "value")
    return candidates.proposed(events, _tagged, "string", 5, "user_id", ["ts", "event_id"])


def b_udtf_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("gatefold_runs", candidates.runs)
    _tables(spark, sf_dir)("events").select("event_id", "user_id", "event_type", "ts").createOrReplaceTempView("gatefold_run_events")
    return spark.sql("SELECT event_id, user_id, event_type, run FROM gatefold_runs(TABLE(gatefold_run_events), 'user_id', 'event_type', 'ts', 'event_id')")


def _first_words(texts: list[str]) -> list[str | None]:
    """A hook in place of a model: the first forty characters up to the last blank among them; a text with a bar has none."""
    return [None if "|" in t else t[:40].rpartition(" ")[0] for t in texts]


def b_hook_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are answered once for each key; the second pass finds all of them in the cache."""
    docs = _tables(spark, sf_dir)("documents").select("doc_id", "text", "lang").withColumn("key", corpus.canonical_key("text"))
    path = shared.new_path(spark)
    template = F.concat(F.lit("a text in "), F.coalesce("lang", F.lit("no language")))
    hooks.fill(docs, path, _first_words, "key", "text", "doc_id", 0)
    return hooks.answered(docs, path, _first_words, "key", "text", "doc_id", template, 1).select("doc_id", "answer")


def b_hook_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fill of the cache wrote, when the items of the benchmark are asked before all documents."""
    t = _tables(spark, sf_dir)
    path = shared.new_path(spark)
    for number, (df, ident) in enumerate(((t("benchmark"), "item_id"), (t("documents"), "doc_id"), (t("documents"), "doc_id"))):
        hooks.fill(df.select(F.col(ident).alias("id"), "text").withColumn("key", corpus.canonical_key("text")), path, _first_words, "key", "text", "id", number)
    return hooks.cache(spark, path).groupBy("fill").agg(F.count(F.lit(1)).alias("asked"), F.count("answer").alias("answered"))


def b_observed_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the pass that writes the pairs; their agreement is far below any threshold, which is reported too."""
    pairs = _statuses(_tables(spark, sf_dir))
    seen = F.col("observed")
    kinds = {"unobserved": seen.isNull(), "partial": (seen == "P") & (F.col("expected") != "P"), "opposite": (seen != F.col("expected")) & (seen != "P")}
    try:
        report = observed.agreement(pairs, shared.new_path(spark), "expected", "observed", kinds=kinds)
    except observed.BelowThreshold as below:
        report = below.report
    names = ("cases", "checked", "agreed", *kinds, "agreement", "passed")
    return spark.createDataFrame([tuple(report[n] for n in names)], ", ".join(f"{n} {dict(agreement='double', passed='boolean').get(n, 'long')}" for n in names))


def b_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written by split, reported on in the same pass, saved as JSON and read again."""
    docs = _tables(spark, sf_dir)("documents").withColumn("split", corpus.whole_bucket(F.floor(F.col("n_chars") / 200), (0,), 10))
    splits, path = ["train", "val", "test"], shared.new_path(spark)
    observed.save(spark, observed.build(docs, f"{path}/corpus", "split", splits, "n_chars"), f"{path}/report")
    report = observed.load(spark, f"{path}/report")
    return spark.createDataFrame([(s, *(report["splits"][s][k] for k in ("n", "size", "max")), report["other"]) for s in splits], "split string, n long, total_size long, max_size long, other long")


QUERIES = {f.__name__: f for f in (b_udtf_candidates, b_udtf_runs, b_hook_cache, b_hook_fills, b_observed_agreement, b_build_report)}

_KEY = r"md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))"
_ANSWER = "CASE WHEN text NOT LIKE '%|%' THEN nullif(trim(regexp_extract(left(text, 40), '(?s)^(.*) [^ ]*$', 1)), '') END"

ORACLE_SQL = {
    "b_udtf_candidates": """
WITH e AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "row" FROM events),
p AS (SELECT user_id, "row", 0 AS k, event_type AS candidate FROM e WHERE event_type <> 'error' UNION ALL SELECT user_id, "row", 1, 'dear ' || event_type FROM e WHERE event_type <> 'error' AND value >= 100),
f AS (SELECT user_id, candidate, min("row" * 2 + k) AS spot FROM p GROUP BY ALL)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY spot) AS place, candidate, spot // 2 AS "row" FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY spot) <= 5""",
    "b_udtf_runs": """
WITH c AS (SELECT *, (event_type IS DISTINCT FROM lag(event_type) OVER w)::INT AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, (sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS run FROM c""",
    "b_hook_cache": f"""
WITH d AS (SELECT doc_id, text, lang, {_KEY} AS k FROM documents), f AS (SELECT k, arg_min(text, doc_id) AS text FROM d GROUP BY k), a AS (SELECT k, {_ANSWER} AS answer FROM f)
SELECT doc_id, coalesce(answer, 'a text in ' || coalesce(lang, 'no language')) AS answer FROM d JOIN a USING (k)""",
    "b_hook_fills": f"""
WITH d AS (SELECT 0 AS fill, item_id AS id, text, {_KEY} AS k FROM benchmark UNION ALL SELECT 1, doc_id, text, {_KEY} FROM documents),
f AS (SELECT k, min(fill) AS fill, arg_min(text, (fill, id)) AS text FROM d GROUP BY k)
SELECT fill, count(*) AS asked, count({_ANSWER}) AS answered FROM f GROUP BY fill""",
    "b_observed_agreement": f"""
SELECT count(*) AS cases, count(observed) AS checked, count(*) FILTER (WHERE expected = observed) AS agreed, count(*) FILTER (WHERE observed IS NULL) AS unobserved,
  count(*) FILTER (WHERE observed = 'P' AND expected <> 'P') AS partial, count(*) FILTER (WHERE observed <> expected AND observed <> 'P') AS opposite,
  round(coalesce(avg((expected = observed)::INT), 0.0), 5) AS agreement, coalesce(avg((expected = observed)::INT), 0.0) >= 0.995 AS passed FROM ({_STATUSES})""",
    "b_build_report": """
SELECT CASE WHEN (n_chars // 200) % 10 = 0 THEN 'test' WHEN (n_chars // 200) % 10 = 1 THEN 'val' ELSE 'train' END AS split, count(*) AS n, sum(n_chars)::BIGINT AS total_size, max(n_chars) AS max_size, 0::BIGINT AS other
FROM documents GROUP BY 1""",
}
