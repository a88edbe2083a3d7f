"""Nearest neighbours by Hamming distance against brute force."""

import random

from pyspark.sql import functions as F

from gatefold.operators import neighbours

SCHEMA = "id long, bits long, label string, other int"


def brute(queries, corpus, k):
    out = []
    for q, a, label, other in set(queries):
        if None in (q, a, label, other):
            continue
        rows = sorted((bin((a ^ b) & (1 << 64) - 1).count("1"), i) for i, b, x, o in corpus if None not in (i, b, x, o) and (x, o) == (label, other) and i != q)
        out += [(q, i, d, n) for n, (d, i) in enumerate(rows[:k], 1)]
    return sorted(out)


def test_nearest_equals_brute_force(spark):
    rng = random.Random(6)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    centres = [rng.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(500):
        turned = rng.choice([0, 1, 2, 5, 9, 20])
        x = rng.choice(centres)
        for b in rng.sample(range(64), turned):
            x ^= 1 << b
        rows.append((i, signed(x), rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([0, 0, 1])))
    rows += [(700 + i, rows[0][1], "hot", 0) for i in range(8)] + [(900, None, "hot", 0), (None, 5, "hot", 0), (901, 1, "alone", 0), (902, 1, "pair", 0), (903, -1, "pair", 0), rows[1]]
    queries = [r for r in rows if r[0] is not None and r[0] % 9 == 0 or r[2] in ("alone", "pair")]
    q, c = (spark.createDataFrame(x, SCHEMA).withColumn("distance0", F.lit(1)).repartition(3) for x in (queries, rows))
    got = neighbours.nearest(q, c, ["label", "other"], "bits", "id", 4)
    assert got.columns == ["query", "neighbour", "distance", "place"]
    want = brute(queries, [*dict.fromkeys(rows[:-1]), rows[-1]], 4)
    assert sorted(map(tuple, got.collect())) == want


def test_nearest_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, "a", 0)], SCHEMA)
    for q, c in ((empty, some), (some, empty), (some, some)):
        assert neighbours.nearest(q, c, ["label"], "bits", "id", 2).collect() == []
