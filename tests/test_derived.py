"""Rounds in one pass, specification faults, fingerprints, layers and files, with nulls, ties and empty tables."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gatefold.functions import specs, steps, texts
from gatefold.operators import attempts
from gatefold.sources import records, shared

VERDICTS = "round int, spec_hash long, cand_idx long, tokens long, kind string, blocks long"


def played(rows, known, keep, threshold, last):
    """The rounds one after the other, with what each carries to the next."""
    known, best, stage, out = set(known), {}, 0, []
    for n in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == n]
        took = []
        for spec in {r[1] for r in own}:
            once = {}
            for _, s, c, t, k, b in own:
                if s == spec and k == "pass":
                    once[t] = min(once.get(t, (b, c)), (b, c))
            took += [(spec, t, b) for (b, c), t in sorted((v, t) for t, v in once.items())[:keep]]
        first = len({r[1] for r in own if r[2] == 0 and r[4] == "pass"})
        out.append((n, len({r[1] for r in own}), first, len(took), sum(t not in known for _, t, _ in took), min(last, stage)))
        known |= {t for _, t, _ in took}
        for s, t, b in took:
            best[s] = min(best.get(s, (b, t)), (b, t))
        stage += first >= threshold * len({r[1] for r in own})
    return out, known, best


@pytest.mark.parametrize("keep", [1, 3])
def test_rounds_equal_a_loop_over_them(spark, keep):
    rng = random.Random(8)
    rows = [(rng.randint(0, 4), rng.randint(0, 6), rng.randint(0, 5), rng.randint(0, 25), rng.choice(["pass", "fail", None]), rng.randint(1, 4)) for _ in range(220)] + [(7, 1, 3, 4, "fail", 2)]
    df = spark.createDataFrame(rows + rows[:5], VERDICTS).withColumn("place", F.lit("x"))
    known = spark.createDataFrame([(3,), (4,), (4,), (99,)], "tokens long")
    report, layouts, best = attempts.rounds(df, known, keep, 0.3, 2)
    want = played(rows + rows[:5], {3, 4, 99}, keep, 0.3, 2)
    assert sorted(map(tuple, report.collect())) == want[0]
    assert {r.tokens for r in layouts.collect()} == want[1]
    assert {r.spec_hash: (r.blocks, r.tokens) for r in best.collect()} == want[2]
    assert all(x.count() == n for x, n in zip(attempts.rounds(df.limit(0), known, keep, 0.3), (0, 3, 0), strict=True))


def test_specification_faults(spark):
    q = lambda *rules: [(n, e) for n, e in rules]
    cases = [
        (([], ["Q"], []), "no rule"), ((list("ABCDEFG"), ["Q"], q(("Q", "A"))), "7 inputs exceed 6"), ((["A"], [f"O{k}" for k in range(7)], q(("Q", "A"))), "7 outputs exceed 6"), ((["B", "A"], ["A", "B"], q(("A", "B"))), "A, B both input and output"),
        ((["A"], ["Q", "R"], q(("Q", "A"))), "no rule for R"), ((["A"], ["Q"], q(("Q", "A"), ("R", "A"))), "no outputs: R"), ((["A"], ["Q"], q(("Q", "A ∧ not C or B"))), "Q refers to B, C"),
        ((["A", "B", "C"], ["Q"], q(("Q", "delay(A, 2)"))), "unused: B, C"), ((["A", "B"], ["Q", "R"], q(("R", "!A"), ("Q", "B xor A"))), None),
    ]
    df = spark.createDataFrame([c for c, _ in cases], "i array<string>, o array<string>, r array<struct<name:string,expression:string>>")
    assert [x.f for x in df.select(texts.spec_fault(F.col("i"), F.col("o"), F.col("r")).alias("f")).collect()] == [f for _, f in cases]


def test_fingerprints_by_their_definition(spark):
    def brute(values):
        h = 0xCBF29CE484222325
        for v in values:
            h = (h ^ v) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    rows = [[], [0], [1, 2, 3], [(1 << 32) - 1, 256, 65_537], [7] * 500]
    df = spark.createDataFrame([(r,) for r in [*rows, None]], "v array<long>")
    assert [x.h for x in df.select(specs.world_fingerprint(F.col("v")).alias("h")).collect()] == [*map(brute, rows), None]


def test_model_sizes(spark):
    assert spark.range(1).select(steps.parameters(*map(F.lit, (128, 384, 12, 1024)))).first()[0] == 128 * 384 + 1536 * 384 + 12 * (4 * 384**2 + 3 * 384 * 1024) + 384 * 128


def test_layers_that_are_none(spark):
    whole = "\n".join(["V#" + "d" * 13 + "L"] * 16)
    cases = [whole, whole.replace("\n", "\r\n") + "\n\nprose, with V", None, "", whole[:-1], "\n".join(whole.split("\n")[:15]), whole + "\n" + "." * 16]
    got = [r.g for r in spark.createDataFrame([(t,) for t in cases], "t string").select(texts.drawn_layer(F.col("t")).alias("g")).collect()]
    assert got[0] == got[1] == [1] * 256 + ([35, 1] + [2] * 13 + [36]) * 16 + [0] * 1024 and got[2:] == [None] * 5


def test_files_are_read_strictly(spark, tmp_path):
    (tmp_path / "grids.jsonl").write_text("[1, 2]\n")
    with pytest.raises(PySparkException, match="a grid has 2 cells"):
        records.read_grids(spark, str(tmp_path / "grids.jsonl")).collect()
    (tmp_path / "cases.jsonl").write_text('{"format": "cases", "seed": 7}\n{"name": "a", "n": 1}\n')
    with pytest.raises(ValueError, match="seed 7"):
        records.read_cache(spark, str(tmp_path / "cases.jsonl"), 8, "name string, n int")
    assert records.read_cache(spark, str(tmp_path / "cases.jsonl"), 7, "name string, n int").collect() == [("a", 1)]


def test_appending_again_adds_nothing(spark):
    path = shared.new_path(spark)
    spark.createDataFrame([('{"format": "cases", "seed": 1}',)], "value string").write.text(path)
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "name string, n int")
    for part in (df.filter("n = 1"), df, df, df.limit(0)):
        records.append_new(part, path, "name", shared.stored(records.read_cache(spark, path, 1, "name string, n int")))
    assert sorted(map(tuple, records.read_cache(spark, path, 1, "name string, n int").collect())) == [("a", 1), ("b", 2), ("b", 2)]
