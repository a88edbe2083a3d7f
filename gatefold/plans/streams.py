"""Streaming queries, each compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatefold.sources import shared
from gatefold.streaming import events as stream, rounds, state, tables


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return stream.read_stream(spark, path, spark.read.parquet(path))


def b_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.result(stream.tumbling(_events(spark, sf_dir)), "complete")


def b_stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.result(stream.sessions(_events(spark, sf_dir)), "complete")


def b_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    return tables.result(state.first_rows(_events(spark, sf_dir), keys, "ts", "event_id"), "update", keys, state.ROCKS_NO_EMPTY)


def b_stateful_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["user_id", "event_type"]
    return tables.result(state.known(_events(spark, sf_dir), keys, "ts", "event_id", "value"), "update", keys, state.ROCKS_NO_EMPTY).drop("fresh", "improved")


def b_stateful_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.result(state.silent(_events(spark, sf_dir), ["user_id"], "ts", 6 * 3600), "append", settings=state.ROCKS)


def _reports(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    path = shared.new_path(spark)
    return _events(spark, sf_dir), path, f"{path}-state"


def b_round_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream runs to its end, then again from the start with its checkpoint lost: the log holds each round once."""
    events, path, state_path = _reports(spark, sf_dir)
    for attempt in ("", "-again"):
        rounds.log_rounds(events, path, state_path + attempt, "event_type", "user_id", F.col("value") >= 50, "value")
    return rounds.round_log(spark, path)


def b_resumed_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted cases by name; a second run finds all of them there and adds none."""
    events, path, state_path = _reports(spark, sf_dir)
    cases = events.filter("value >= 50").select(F.concat_ws("-", "event_type", "user_id").alias("name"), "event_id", "value")
    for attempt in ("", "-again"):
        rounds.cache_cases(cases, path, state_path + attempt, "name", "event_id")
    return rounds.cached_cases(spark, path, cases.schema).drop(tables.BATCH)


QUERIES = {f.__name__: f for f in (b_stream_tumbling, b_stream_session, b_stream_dedup, b_stateful_known, b_stateful_silent, b_round_log, b_resumed_cache)}
ORACLE_SQL = {
    "b_stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "b_stream_session": """
WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR) IS NOT TRUE AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, floor(epoch(min(ts)))::BIGINT AS started, count(*) AS n FROM s GROUP BY user_id, k""",
    "b_stream_dedup": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "b_stateful_known": """
SELECT user_id, event_type, epoch_us(min(ts)) AS first_at, arg_min(event_id, (ts, event_id)) AS first_id, max(value) AS best, epoch_us(arg_min(ts, (-value, ts, event_id))) AS best_at,
  arg_min(event_id, (-value, ts, event_id)) AS best_id, count(*) AS n FROM events GROUP BY user_id, event_type""",
    "b_stateful_silent": """
WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR) IS NOT TRUE AS fresh FROM events),
s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
c AS (SELECT user_id, min(ts) AS began, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(began) AS began, epoch_us(ended) AS ended, n FROM c WHERE ended + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    "b_round_log": """
SELECT 0::BIGINT AS round, event_type, count(*) AS candidates, count(DISTINCT user_id) AS specs, count(*) FILTER (WHERE value >= 50) AS accepted, max(value) AS best FROM events GROUP BY event_type""",
    "b_resumed_cache": "SELECT event_type || '-' || user_id AS name, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE value >= 50 GROUP BY 1",
}
