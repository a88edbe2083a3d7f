import gzip

from pyspark.sql import functions as F

from gatefold import vocab
from gatefold.functions import grids, specs
from gatefold.operators import metrics
from gatefold.sources import records, schematics

#: Keys of known truth tables.
KEYS = [
    (1, 1, [0, 1], "d7c60080363b0a16"), (1, 1, [1, 0], "a7c2b1c12e153bf6"), (2, 1, [1, 1, 1, 0], "649af46289d7e8ed"), (2, 1, [0, 0, 0, 1], "55e69bf89c25c4ad"),
    (2, 1, [0, 1, 1, 0], "0e9568633b8b4cac"), (2, 2, [0, 1, 2, 3], "b32f0cefa8564825"), (3, 1, [0, 1, 1, 0, 1, 0, 0, 1], "e8a0ada2d5590549"),
]


def test_semantic_keys(spark):
    df = spark.createDataFrame([k[:3] for k in KEYS], "a int, b int, rows array<bigint>")
    assert [r.k for r in df.select(specs.semantic_key(F.col("a"), F.col("b"), F.col("rows")).alias("k")).collect()] == [k[3] for k in KEYS]


def test_enumeration_counts(spark):
    assert [specs.enumerate_functions(spark, n).count() for n in (1, 2, 3)] == [2, 10, 218]


def test_rules_follow_the_language(spark):
    got = specs.truth_table(spark, ["A", "B"], {"P": "A", "Q": "B"}).orderBy("m").collect()
    assert [r.outputs for r in got] == [0, 1, 2, 3]
    nand = specs.truth_table(spark, ["A", "B"], {"Y": "not (A and B)"}).orderBy("m").collect()
    assert [r.outputs for r in nand] == [1, 1, 1, 0]


def test_vocabulary():
    assert len(vocab.ROWS) == 48 and vocab.ROWS[8][7].startswith("minecraft:repeater[facing=south,delay=1")


def test_metrics(spark):
    rounds = spark.createDataFrame([(1, 0.30, 8.0, 0.9, 0.0), (2, 0.50, 4.0, 0.5, 0.0), (3, 0.70, 1.2, 0.1, 0.0)], "r int, s double, v double, f double, u double")
    assert metrics.collapse(rounds, "r", "s", "v", "f", "u").filter("r = 3").first().alarm == "collapsing"
    points = spark.createDataFrame([(20, 3), (25, 3), (20, 5), (18, 6)], "a int, b int")
    assert sorted(map(tuple, metrics.skyline(points, "a", "b").collect())) == [(18, 6), (20, 3)]
    draws = spark.createDataFrame([("s", k, k == 7) for k in range(10)], "g string, i int, ok boolean")
    got = metrics.pass_at_k(draws, "g", ["i"], F.col("ok")).first()
    assert (got.pass_at_1, got.pass_at_8) == (0.0, 1.0)


def test_schematics_round_trip():
    tokens = bytes([1] * 256 + [k % 44 for k in range(1280)])
    blob = schematics.to_schem(tokens)
    assert blob == schematics.to_schem(tokens)
    w, h, n, states = schematics.from_schem(blob)
    assert (w, h, n) == (16, 6, 16) and states == [schematics.STATES[t] for t in tokens]
    assert [schematics.varint(x).hex() for x in (0, 127, 128, 300)] == ["00", "7f", "8001", "ac02"]
    assert gzip.decompress(blob)[:1] == b"\n"


def test_substrate_render(spark):
    df = spark.range(1).select(grids.substrate().alias("g"))
    got = df.select(F.size("g").alias("n"), grids.material_blocks(F.col("g")).alias("b"), grids.layer_text(F.col("g"), F.lit(0)).alias("t")).first()
    assert got.n == 1536 and got.b == 0 and got.t.splitlines() == ["#" * 16] * 16


def test_records_are_strict(spark, tmp_path):
    good = '{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}\n'
    (tmp_path / "x.jsonl").write_text(good)
    assert records.read_examples(spark, f"file://{tmp_path}/x.jsonl", "a int, b string").count() == 2
    (tmp_path / "y.jsonl").write_text('{"a": 1, "c": "x"}\n')
    try:
        records.read_examples(spark, f"file://{tmp_path}/y.jsonl", "a int, b string").collect()
    except Exception as e:  # noqa: BLE001
        assert "keys of a record differ" in str(e)
    else:
        raise AssertionError("a record with other keys was read")
