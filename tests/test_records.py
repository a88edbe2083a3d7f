"""Random specifications, records, constructions and payloads."""

import base64
import itertools
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gatefold.functions import random_specs
from gatefold.operators import examples
from gatefold.vocab import CELLS


def truth(rule, n):
    text = rule.translate(str.maketrans({"¬": "~", "∧": "&", "∨": "|", "⊕": "^"}))
    code = compile(text, "rule", "eval")
    return [eval(code, {}, {name: m >> k & 1 for k, name in enumerate("ABCDEF")}) & 1 for m in range(1 << n)]


@pytest.mark.parametrize("config", [random_specs.Config(), random_specs.Config(3, 12, 5, 6, ("xor", "and"), 1.0)])
def test_random_specifications(spark, config):
    seeds = spark.createDataFrame([(k,) for k in range(80)] * 2 + [(None,)], "k long")
    rows = random_specs.with_identity(random_specs.random_specs(seeds, "k", config)).collect()
    assert sorted(r.seed for r in rows) == list(range(80))
    again = {r.seed: r.rule for r in random_specs.random_specs(seeds.limit(50), "k", config).collect()}
    for r in rows:
        assert r.rows == truth(r.rule, r.n_inputs) and config.min_inputs <= r.n_inputs <= config.max_inputs
        signs = re.findall("[¬∧∨⊕]", r.rule)
        assert r.gates == len(signs) and config.min_gates <= r.gates <= config.max_gates and "¬¬" not in r.rule and "¬(¬" not in r.rule
        assert {random_specs.SIGNS[g] for g in config.gate_set} | {"¬"} >= set(signs)
        for k in range(r.n_inputs):
            assert any(r.rows[m] != r.rows[m ^ 1 << k] for m in range(1 << r.n_inputs)), "an input without effect"
        limits = [r.max_latency is not None, r.max_blocks is not None, r.region_z is not None]
        assert sum(limits) <= 1 and (config.constraint_rate < 1 or sum(limits) == 1)
        assert r.max_latency is None or 2 <= r.max_latency - r.gates <= 5
        assert r.max_blocks is None or 60 <= r.max_blocks <= 120
        assert (r.region_x is None) == (r.region_z is None) and (r.region_z is None or (r.region_x == 16 and 10 <= r.region_z <= 16))
        assert r.spec_source.endswith(f"Q = {r.rule}") and (again.get(r.seed) or r.rule) == r.rule
    assert len({r.n_inputs for r in rows}) == config.max_inputs - config.min_inputs + 1


def test_specifications_that_cannot_be(spark, monkeypatch):
    with pytest.raises(ValueError):
        random_specs.Config(1, 2, 4, 4)
    assert random_specs.random_specs(spark.range(0), "id").collect() == []
    monkeypatch.setattr(random_specs, "TRIES", (1,))
    with pytest.raises(RuntimeError, match="seeds have no specification in 1 tries"):
        random_specs.random_specs(spark.range(60), "id")


def test_constraints_replace_constraints(spark):
    own = random_specs.with_identity(random_specs.random_specs(spark.range(30), "id"))
    new = random_specs.with_constraints(own, max_blocks=70)
    assert {(r.max_latency, r.max_blocks, r.region_x) for r in new.collect()} == {(None, 70, None)}
    assert all("\nfootprint <= 70\n" in r.spec_source and "latency" not in r.spec_source for r in new.collect())
    assert {(r.seed, r.spec_hash) for r in own.collect()} == {(r.seed, r.spec_hash) for r in new.collect()}
    with pytest.raises(ValueError):
        random_specs.with_constraints(own, max_height=3)


def test_records_hold_verified_layouts(spark):
    specs = spark.createDataFrame([("a", "src a", "ha", 2, 1, 1, [0, 1]), ("b", "src b", "hb", 1, 1, 1, [1, 0]), (None, "src n", "hn", 1, 1, 1, [1, 0])], "k string, spec_source string, spec_hash string, gates int, n_inputs int, n_outputs int, rows array<long>")
    layout = "k string, kind string, input_z array<int>, output_z array<int>, tokens array<int>, latency_rt int, blocks int, bbox array<int>"
    layouts = spark.createDataFrame([("a", "pass", [1], [7], [1, 0], 3, 4, [1, 1, 1]), ("a", "pass", [1], [7], [1, 0], 3, 4, [1, 1, 1]), ("a", "fail", [1], [7], [1, 1], 3, 4, [1, 1, 1]), ("b", "fail", [1], [7], [1], 1, 1, [1]), (None, "pass", [1], [7], [1], 1, 1, [1]), ("c", "pass", [1], [7], [1], 1, 1, [1])], layout)
    prompts = spark.createDataFrame([("a", "two"), ("a", "one"), ("a", "two"), ("a", None), ("c", "x")], "k string, prompt string")
    rows = examples.examples(specs, layouts, prompts, "k").collect()
    assert [tuple(r) for r in rows] == [("src a", "ha", 2, 1, 1, [0, 1], [1], [7], [1, 0], 3, 4, [1, 1, 1], ["one", "two"])] * 2
    assert examples.examples(specs, layouts, prompts.limit(0), "k").first().prompts == []
    assert examples.examples(specs, layouts.limit(0), prompts, "k").columns == list(examples.FIELDS)


def test_constructions(spark):
    schema = "i array<struct<x:int,z:int>>, o array<struct<x:int,z:int>>, rows array<long>"
    two = [(0, 1), (0, 3)]
    cases = [
        ((None, [(15, 7)], [1]), "no inputs"), (([], [(15, 7)], [1]), "no inputs"), (([(0, z) for z in range(7)], [(15, 7)], [0] * 128), "7 inputs exceed 6"),
        ((two, None, [0] * 4), "no outputs"), ((two, [(15, z) for z in range(7)], [0] * 4), "7 outputs exceed 6"), ((two, [(15, 7)], [0] * 3), "the table has 3 rows, not 4"), ((two, [(15, 7)], None), "the table has 0 rows, not 4"),
        (([(0, 1), (1, 3)], [(14, 7)], [0] * 4), "input port (1, 3) is not on the x=0 face"), ((two, [(14, 7)], [0] * 4), "output port (14, 7) is not on the x=15 face"),
        (([(0, 1), (0, 1)], [(14, 7)], [0] * 4), "two ports share (0, 1)"), ((two, [(15, 7), (15, 7)], [0] * 4), "two ports share (15, 7)"), ((two, [(15, 1), (15, 7)], [0] * 4), None), (([(0, z) for z in range(6)], [(15, 1)], [0] * 64), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], schema)
    assert [r.f for r in df.select(examples.construction_fault(F.col("i"), F.col("o"), F.col("rows")).alias("f")).collect()] == [f for _, f in cases]


def test_payloads(spark):
    grid = bytes(k % 256 for k in range(CELLS))
    df = spark.createDataFrame([(bytearray(grid), base64.b64encode(grid).decode(), list(grid)), (None, None, None)], "b binary, s string, t array<int>")
    for c, kind in (("b", "binary"), ("s", "base64"), ("t", "tokens")):
        assert [r[0] and bytes(r[0]) for r in df.select(examples.payload(F.col(c), kind)).collect()] == [grid, None]
    assert df.select(examples.base64_text(F.col("b"))).first()[0] == base64.b64encode(grid).decode()
    for bad, kind in itertools.chain(((bytearray(b"x"), "binary"), ("YQ==", "base64"), ([1], "tokens"), ([256] * CELLS, "tokens"), ([None] * CELLS, "tokens"))):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], f"c {dict(binary='binary', base64='string', tokens='array<int>')[kind]}").select(examples.payload(F.col("c"), kind)).collect()


def test_cells_and_sizes(spark):
    tokens = [0] * CELLS
    tokens[2 * 256 + 5 * 16 + 3], tokens[3 * 256 + 9 * 16 + 4] = 7, 8
    df = spark.createDataFrame([(tokens,), ([0] * CELLS,)], "t array<int>")
    at = [examples.cell(F.col("t"), *map(F.lit, p)) for p in ((3, 2, 5), (0, 0, 0), (16, 0, 0), (0, 6, 0), (0, 0, -1))]
    assert [tuple(r) for r in df.select(*at).collect()] == [(7, 0, None, None, None), (0, 0, None, None, None)]
    assert [tuple(r.s) for r in df.select(examples.occupied_size(F.col("t")).alias("s")).collect()] == [(2, 2, 5), (0, 0, 0)]
