"""Running aggregates over ranges and what is built on them, peeling, sampling to quotas, each against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gatefold.operators import circuits, metrics, ordered, sampling, scan


def rows_of(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40)]), i, rng.choice([None, *range(-9, 9)])) for i in range(n)]


@pytest.mark.parametrize("how", ["sum", "min", "max", "xor"])
@pytest.mark.parametrize("kind", ["long", "double"])
def test_running_aggregates(spark, how, kind):
    if (how, kind) == ("xor", "double"):
        return
    rows = rows_of(1, 300)
    df = spark.createDataFrame(rows, "a int, id long, v int").withColumn("v", F.col("v").cast(kind)).withColumn("_extra", F.lit("x")).repartition(5)
    got = {r.id: (r.before, r.running) for r in scan.scanned(df, ["a", "id"], "v", how, parts=7).collect()}
    op = {"sum": lambda a, b: a + b, "min": min, "max": max, "xor": lambda a, b: a ^ b}[how]
    so_far = None
    for _, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        after = so_far if v is None else v if so_far is None else op(so_far, v)
        assert got[i] == (so_far, after), i
        so_far = after


def test_scans_of_ties_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 5)] * 40 + [(0, None)], "a int, v long")
    got = scan.scanned(df, ["a"], "v", "sum", parts=3)
    assert got.columns == ["a", "v", "before", "running"]
    assert sorted(r.running for r in got.filter("a = 1").collect()) == [5 * k for k in range(1, 41)]
    assert scan.scanned(df.limit(0), ["a"], "v", "sum").collect() == []
    assert sorted(r.place for r in scan.numbered(df, ["a"], parts=4).collect()) == list(range(1, 42))


def test_skyline(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(500)] + [(None, 0), (0, None), (7, 7), (7, 7)]
    real = [p for p in pairs if None not in p]
    want = sorted({(a, b) for a, b in real if not any((c <= a and d <= b) and (c, d) != (a, b) for c, d in real)})
    assert sorted(map(tuple, metrics.skyline(spark.createDataFrame(pairs, "a int, b int"), "a", "b", 6).collect())) == want
    assert metrics.skyline(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []


def test_depth_by_peeling(spark):
    rng = random.Random(3)
    edges = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)] + [(1, 2), (1, 2), (None, 3), (4, None), (70, 71), (71, 72), (70, 72)]
    df = spark.createDataFrame(edges, "source int, target int").withColumn("depth", F.lit("a column of that name"))
    own = {e for e in edges if None not in e}
    depth = {}
    for node in sorted({n for e in own for n in e}):
        depth[node] = max((depth[a] + 1 for a, b in own if b == node), default=0)
    assert {r.node: r.depth for r in circuits.depth(df).collect()} == depth
    placed = {r.node: r.place for r in circuits.topological(df).collect()}
    assert [n for n, _ in sorted(placed.items(), key=lambda x: x[1])] == sorted(depth, key=lambda n: (depth[n], n)) and all(placed[a] < placed[b] for a, b in own)


def test_cycles_and_empty_graphs(spark):
    with pytest.raises(circuits.Cyclic, match="3 nodes"):
        circuits.depth(spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4)], "source int, target int"))
    with pytest.raises(circuits.Cyclic):
        circuits.depth(spark.createDataFrame([(1, 1)], "source int, target int"))
    assert circuits.depth(spark.createDataFrame([], "source int, target int")).collect() == []


def sample(rows, quotas, seed, good):
    first = {}
    for k, o, s, v in rows:
        if k is not None and (k not in first or o < first[k][0]):
            first[k] = (o, s, v)
    out = []
    for s, q in quotas.items():
        mine = sorted((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k) for k, (_, t, v) in first.items() if t == s and good(v))
        out += [(s, k) for _, k in mine[:q]]
    return sorted(out)


@pytest.mark.parametrize("bar", [0, 50, 97])
def test_samples_fill_quotas_in_hash_order(spark, bar):
    rng = random.Random(4)
    rows = [(rng.choice([None, *map(str, range(1500))]), i, rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 99)) for i in range(2500)]
    asked = []

    def accept(df):
        asked.append(df.count())
        return df.filter(F.col("v") >= bar)

    df = spark.createDataFrame(rows, "k string, o int, s string, v int").withColumn("place0", F.lit(1))
    quotas = {"a": 40, "b": 3, "c": 2, "none": 0}
    got = sampling.to_quota(df, "k", "o", "s", quotas, accept, "seed")
    assert sorted((r.s, r.k) for r in got.collect()) == sample(rows, quotas, "seed", lambda v: v >= bar)
    assert got.columns == [*df.columns, "place"] and (bar or sum(asked) <= 66)
    assert bar != 50 or sum(asked) < 300
    if bar == 97:
        with pytest.raises(sampling.TooFew, match="c 0 of 2"):
            sampling.to_quota(df, "k", "o", "s", quotas, accept, "seed", strict=True)


def test_samples_of_nothing(spark):
    df = spark.createDataFrame([], "k string, o int, s string")
    assert sampling.to_quota(df, "k", "o", "s", {"a": 1}, lambda d: d).collect() == []
    assert sampling.to_quota(df, "k", "o", "s", {}, lambda d: d).columns == ["k", "o", "s", "place"]


def test_recurrence_of_whole_states(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), i, rng.choice(["x", "y", None]), rng.choice([None, 0, 1, 2])) for i in range(60)]
    want = {}
    for key in {r[0] for r in rows}:
        state, seen = {}, {}
        for place, (_, _, c, v) in enumerate([r for r in rows if r[0] == key], 1):
            state[c] = v
            now = frozenset(state.items())
            if now in seen:
                want[key] = (place, seen[now], place - seen[now])
                break
            seen[now] = place
    df = spark.createDataFrame(rows, "k int, t int, c string, v int").withColumn("place", F.lit(9)).repartition(4)
    assert {r.k: tuple(r)[1:] for r in ordered.recurrence(df, "k", ["t"], "c", "v", 5).collect()} == want
    assert ordered.recurrence(df.limit(0), "k", ["t"], "c", "v").collect() == []


def test_a_card_in_files(spark, tmp_path):
    from gatefold.operators import corpus

    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b"), (2, "a")], "n int, s string").repartition(3)
    corpus.write_card(df, ["s", "n"], ["n", "s"], f"file://{tmp_path}/card")
    text = "".join(p.read_text() for p in sorted((tmp_path / "card").glob("part-*")))
    assert text.splitlines() == ["| s | n |", "| --- | --- |", "|  | 1 |", "| a | 2 |", "| b | 2 |", "| c | 3 |"]
    assert corpus.card_lines(df.limit(0), ["s"], ["n"]).count() == 2
