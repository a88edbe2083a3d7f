"""Streams whose state is carried over several micro-batches, and tables that repeated batches leave as they are."""

import datetime
import random

from pyspark.sql import functions as F

from gatefold.sources import shared
from gatefold.streaming import rounds, state, tables

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double"


def batch(spark, path, rows):
    spark.createDataFrame([(i, None if t is None else datetime.datetime.fromtimestamp(t, datetime.timezone.utc), u, k, v) for i, t, u, k, v in rows], EVENTS).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENTS).parquet(path)


def drawn(seed, n, begin=0):
    rng = random.Random(seed)
    return [(begin + i, rng.randint(0, 50) * 600 + begin * 100, rng.randint(0, 3), rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 5.5])) for i in range(n)]


def test_known_carries_state_over_batches_in_any_order(spark):
    path, out = shared.new_path(spark), shared.new_path(spark)
    parts = [[*drawn(k, 40, 40 * k), (900 + k, None, 1, "a", 99.0), (950 + k, 600, 1, "a", 5.5)] for k in (2, 0, 1)]
    for rows in parts:
        batch(spark, path, rows)
        tables.run(state.known(stream(spark, path), ["user_id", "event_type"], "ts", "event_id", "value"), "update", out, f"{out}-state", settings=state.ROCKS_NO_EMPTY)
    seen = tables.table(spark, out, spark.read.parquet(out).drop(tables.BATCH).schema)
    assert seen.select(tables.BATCH).distinct().count() == 3
    got = {(r.user_id, r.event_type): tuple(r)[2:8] for r in tables.last_of(seen, ["user_id", "event_type"]).collect()}
    want = {}
    for i, t, u, k, v in (r for rows in parts for r in rows if r[1] is not None):
        want.setdefault((u, k), []).append((t * 1_000_000, i, v))
    for key, rows in want.items():
        first, best = min(r[:2] for r in rows), min(((-v, t, i) for t, i, v in rows if v is not None), default=None)
        assert got[key] == (*first, *((-best[0], *best[1:]) if best else (None, None, None)), len(rows)), key
    assert got.keys() == want.keys()
    fresh = seen.filter("fresh").groupBy("user_id", "event_type").count().collect()
    assert {r["count"] for r in fresh} == {1} and len(fresh) == len(want)


def test_a_key_is_forgotten_after_its_time(spark):
    path, out = shared.new_path(spark), shared.new_path(spark)
    for k in range(2):
        batch(spark, path, [(k, k, 7, "a", 1.0)])
        tables.run(state.first_rows(stream(spark, path), ["user_id"], "ts", "event_id", ttl=1), "update", out, f"{out}-state", settings=state.ROCKS_NO_EMPTY)
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [0, 1]


def test_silent_spans_close_with_the_watermark(spark):
    path, out = shared.new_path(spark), shared.new_path(spark)
    hour = 3600
    batches = [[(0, 0, 1, "a", 1.0), (1, hour, 1, "a", 1.0), (2, 9 * hour, 1, "a", 1.0), (3, 8 * hour, 2, "a", 1.0), (4, None, 2, "a", 1.0)], [(5, int(8.5 * hour), 1, "a", 1.0), (6, 30 * hour, None, "a", 1.0), (7, 0, 1, "late", 1.0)]]
    found = []
    for rows in batches:
        batch(spark, path, [(i, None if t is None else t + 100 * hour, *more) for i, t, *more in rows])  # no row at the first watermark
        tables.run(state.silent(stream(spark, path), ["user_id"], "ts", 6 * hour), "append", out, f"{out}-state", settings=state.ROCKS)
        found.append(sorted((r.user_id, r.began // 10**6 // 1800 - 200, r.ended // 10**6 // 1800 - 200, r.n) for r in spark.read.parquet(out).collect()))
    assert found == [[(1, 0, 2, 2)], [(1, 0, 2, 2), (1, 17, 18, 2), (2, 16, 16, 1)]]


def test_streams_over_empty_tables(spark):
    path = shared.new_path(spark)
    spark.createDataFrame([], EVENTS).write.parquet(path)
    assert tables.result(state.known(stream(spark, path), ["user_id"], "ts", "event_id", "value"), "update", ["user_id"], state.ROCKS_NO_EMPTY).collect() == []
    assert tables.result(stream(spark, path).groupBy("event_type").count(), "complete").collect() == []


def test_a_repeated_round_adds_nothing(spark):
    path, out = shared.new_path(spark), shared.new_path(spark)
    passed = F.col("value") >= 2
    logs = []
    for k in range(2):
        batch(spark, path, drawn(k, 30, 30 * k))
        rounds.log_rounds(stream(spark, path), out, f"{out}-state", "event_type", "user_id", passed, "value")
    logs.append(sorted(map(tuple, rounds.round_log(spark, out).collect()), key=str))
    rounds.log_rounds(stream(spark, path), out, f"{out}-state", "event_type", "user_id", passed, "value")  # nothing new
    one = spark.createDataFrame([], EVENTS).unionByName(spark.read.schema(EVENTS).parquet(path).filter("event_id >= 30"))
    tables.put(rounds.report(one, "event_type", "user_id", passed, "value"), out, 1)  # the second round by hand once more
    logs.append(sorted(map(tuple, rounds.round_log(spark, out).collect()), key=str))
    assert logs[0] == logs[1] and {r[0] for r in logs[0]} == {0, 1} and {r[1] for r in logs[0]} == {"a", "b", None}


def test_a_cache_takes_each_name_once_over_restarts(spark):
    path, out = shared.new_path(spark), shared.new_path(spark)
    for k, own in enumerate(["", "", "-lost", "-lost"]):
        if k < 2:
            batch(spark, path, [(10 * k + 1, 0, 0, "x", 1.0), (10 * k, 0, 0, "x", 2.0), (10 * k + 2, 0, 0, f"only{k}", 3.0), (5, 0, 0, None, 0.0)])
        cases = stream(spark, path).selectExpr("event_type AS name", "event_id", "value")
        rounds.cache_cases(cases, out, f"{out}-state{own}", "name", "event_id")
        got = sorted(tuple(r)[:3] for r in rounds.cached_cases(spark, out, cases.schema).collect())
        assert got == [("only0", 2, 3.0), *([("only1", 12, 3.0)] if k else []), ("x", 0, 2.0)]
