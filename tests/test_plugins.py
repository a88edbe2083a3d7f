"""Plugged-in samplers and text hooks, and reports observed while tables are written."""

import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from gatefold.operators import candidates, hooks, observed
from gatefold.sources import shared

ROWS = [(1, "a", 3.0), (2, "b", None), (3, "a", 1.0), (4, None, 2.0), (5, None, 2.0), (6, "a", 3.0), (7, "b", 9.0)]


@pytest.fixture
def both():
    return lambda row, k: [row["v"], None if row["v"] is None else row["v"] * 10]  # a function of this module is none of a worker's


def test_a_sampler_proposes_different_candidates_in_order(spark, both):
    df = spark.createDataFrame(ROWS, "id long, g string, v double").selectExpr("*", "'x' AS place", "1 AS candidate").repartition(3)
    got = candidates.proposed(df, both, "double", 3, "g", ["id"])
    assert got.columns == ["g", "place", "candidate", "row"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([("a", 1, 3.0, 1), ("a", 2, 30.0, 1), ("a", 3, 1.0, 2), ("b", 1, 9.0, 2), ("b", 2, 90.0, 2), (None, 1, 2.0, 1), (None, 2, 20.0, 1)], key=str)
    assert candidates.proposed(df.limit(0), both, "double", 3, "g", ["id"]).collect() == []


def test_the_function_takes_its_types_from_the_table(spark, both):
    df = spark.createDataFrame([(1, 7, "x"), (2, 7, "y")], "id int, g long, v string")
    got = candidates.proposed(df, lambda row, k: [row["v"] + str(k)], "string", 4, "g", ["id"])
    assert dict(got.dtypes) == {"g": "bigint", "place": "int", "candidate": "string", "row": "bigint"}
    assert sorted(r.candidate for r in got.collect()) == ["x4", "y4"]
    with pytest.raises(AnalysisException, match="names no column"):
        candidates.proposed(df, both, "double", 3, "missing", ["id"])


def test_runs_keep_every_column_of_any_table(spark):
    df = spark.createDataFrame(ROWS, "id long, g string, v double").withColumn("more", F.array("id"))
    got = candidates.runs(df.asTable(), F.lit("g"), F.lit("v"), F.lit("id"))
    assert got.columns == [*df.columns, "run"]
    assert {r.id: r.run for r in got.collect()} == {1: 1, 3: 2, 6: 3, 2: 1, 7: 2, 4: 1, 5: 1}


def test_a_hook_answers_each_text_once(spark, tmp_path):
    log = tmp_path / "calls"

    def hook(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [None if "none" in t else " " if "blank" in t else t.upper() for t in texts]

    path = shared.new_path(spark)
    rows = [(1, "k1", "one"), (2, "k1", "other one"), (2, "k1", "one"), (3, "k2", "none"), (4, "k3", "blank"), (5, None, "lost"), (6, "k4", None), (7, "k5", "five")]
    df = spark.createDataFrame(rows, "id long, key string, text string").selectExpr("*", "'mine' AS answer0", "1 AS fill")
    for part, number in ((df.filter("id < 4"), 0), (df, 1), (df, 1), (df, 5)):
        got = hooks.answered(part, path, hook, "key", "text", "id", F.concat(F.lit("template "), "id"), number)
        assert got.columns == [*df.columns, "answer"]
    answers = sorted((r.id, r.answer) for r in got.collect())
    assert answers == [(1, "ONE"), (2, "ONE"), (2, "ONE"), (3, "template 3"), (4, "template 4"), (5, "template 5"), (6, "template 6"), (7, "FIVE")]
    assert sorted(log.read_text().split("\n")[:-1]) == ["blank", "five", "none", "one"]
    assert sorted((r.key, r.fill) for r in hooks.cache(spark, path).collect()) == [("k1", 0), ("k2", 0), ("k3", 1), ("k5", 1)]


def test_a_fill_that_grew_adds_what_it_lacked(spark):
    path = shared.new_path(spark)
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, key string, text string")
    hooks.fill(df.limit(0), path, list, "key", "text", "id", 0)
    assert hooks.cache(spark, path).count() == 0
    hooks.fill(df.filter("id = 1"), path, list, "key", "text", "id", 0)
    hooks.fill(df, path, list, "key", "text", "id", 0)
    assert sorted(tuple(r)[:2] for r in hooks.cache(spark, path).collect()) == [("a", "x"), ("b", "y")]
    with pytest.raises(PythonException, match="have 0 answers"):
        hooks.fill(df.withColumn("key", F.lit("new")), path, lambda texts: [], "key", "text", "id", 9)


def test_a_report_below_its_threshold_fails_and_leaves_the_rows(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "a", "b"), (3, "a", None), (3, "a", "a")], "id long, e string, o string")
    path = shared.new_path(spark)
    with pytest.raises(observed.BelowThreshold, match="0.6667 is below 0.9") as below:
        observed.agreement(df, path, "e", "o", 0.9, {"b": F.col("o") == "b"})
    assert {k: below.value.report[k] for k in ("cases", "checked", "agreed", "b", "passed")} == {"cases": 4, "checked": 3, "agreed": 2, "b": 1, "passed": False}
    assert spark.read.parquet(path).count() == 4
    assert observed.agreement(df, path, "e", "o", 0.6)["passed"]
    with pytest.raises(observed.BelowThreshold):
        observed.agreement(df, path, "e", "o", 0.9, remove=True)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


def test_reports_of_empty_and_unobserved_tables(spark):
    df = spark.createDataFrame([], "id long, e string, o string")
    assert observed.agreement(df, shared.new_path(spark), "e", "o", dry_run=True)["agreement"] == 0
    with pytest.raises(observed.BelowThreshold):
        observed.agreement(df, shared.new_path(spark), "e", "o")
    path = shared.new_path(spark)
    rows = spark.createDataFrame([("a", 2), ("a", 5), (None, 1), ("odd", None)], "split string, n long")
    report = observed.build(rows, path, "split", ["a", "b"], "n")
    assert report["splits"] == {"a": {"n": 2, "size": 7, "max": 5}, "b": {"n": 0, "size": None, "max": None}} and report["other"] == 2
    assert spark.read.parquet(path).count() == 4
    for k in (1, 2):
        observed.save(spark, report | {"k": k}, f"{path}-report")
    assert observed.load(spark, f"{path}-report") == report | {"k": 2}


def test_the_rows_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("id", "'x' AS e", "'x' AS o").mapInArrow(passing, "id long, e string, o string")
    assert observed.agreement(df, shared.new_path(spark), "e", "o")["agreed"] == 100 and seen.value == 100
