"""The CPU seconds of the line dedup: what it compares, counts and writes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gatefold.llm import graph, linededup, scratch


def test_similar_lines_of_a_bucket_are_compared_with_one(monkeypatch):
    """All pairs of the first buckets were asked, though their first members' links join them."""
    rng = np.random.default_rng(3)
    words, of, n = [], 20, 20
    for _ in range(of):
        base = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
        words += [np.where(np.arange(60) == k, base + np.uint32(1), base) for k in range(n)]
    asked, own = [], linededup.edits
    monkeypatch.setattr(linededup, "edits", lambda a, b, most: asked.append(len(a)) or own(a, b, most))
    ids = pa.array(range(of * n), pa.int64())
    group = pa.table({"bucket": pa.array(np.repeat(np.arange(of), n)), "uid": ids, "component": ids, "chunk": pa.array([0] * (of * n), pa.int32()), "words": pa.array([w.astype("<u4").tobytes() for w in words])})
    assert linededup.compared(group, 0.9).num_rows == of * (n - 1)
    assert sum(asked) == of * (n - 1)


def test_both_tables_of_edits_agree(monkeypatch):
    rng = np.random.default_rng(4)
    a = [rng.integers(0, 6, n).astype("<u4") for n in rng.integers(0, 40, 300)]
    b = [np.delete(np.where(rng.random(len(x)) < 0.1, 9, x), slice(0, rng.integers(0, 3))).astype("<u4") for x in a]
    most = rng.integers(0, 12, 300)
    got = linededup.edits(a, b, most).tolist()
    monkeypatch.setattr(linededup, "HELD", 0)  # every pair by rows
    assert linededup.edits(a, b, most).tolist() == got
    x, y = rng.integers(0, 300, (2, 500))
    assert linededup.both_hold(a, x, y).tolist() == linededup.overlaps([a[k] for k in x], [a[k] for k in y]).tolist()


def test_hashes_that_recur_are_counted_in_arrays(spark, monkeypatch):
    """Each hash was a row of the shuffle."""
    rows = spark.range(0, 30_000, 1, 3).select("id", F.xxhash64("id").alias("x"), F.when(F.col("id") % 50 == 0, F.lit(-5)).otherwise(F.xxhash64("id", "id")).alias("y"), F.lit(4).alias("size"))
    rows = rows.union(rows.filter("id = 8 OR id = 19"))
    assert graph.recurring(rows.limit(0).select("x", "y"), 0).count() == 0
    got = {r.bucket: r.n for r in graph.recurring(rows.select("x", "y"), 60_000).collect()}
    want = {r.v: r["count"] for r in rows.select(F.explode(F.array("x", "y")).alias("v")).groupBy("v").count().filter("count > 1").collect()}
    assert got == want and got[-5] == 600 and len(got) == 5
    found = {tuple(r) for r in graph.shared_of(rows.withColumnRenamed("id", "uid"), ["x", "y"], 30_000).collect()}
    assert found == {(band, v, r.id, 4, want[v]) for r in rows.collect() for band, v in enumerate((r.x, r.y)) if v in want}


def test_lines_too_short_to_resemble_another_have_no_bands(spark):
    docs = scratch.stored(spark.createDataFrame([(k, f"some words of line {k}\nothers") for k in range(9)], "doc_id long, text string").withColumn("code", F.xxhash64("text")))
    table = linededup.lines(docs)
    assert table.count() == 18 and {"band0", "band5"} < set(table.columns)
    assert table.filter("band0 IS NOT NULL").count() == 0
