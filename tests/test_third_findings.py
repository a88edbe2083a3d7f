"""What the reviewer found in the third round, on tables small enough to make here."""

import os
import random
import time
import tracemalloc

import duckdb
import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gatefold.functions import random_specs
from gatefold.llm import graph, langid, linededup, minhash, scratch, toxicity
from gatefold.llm.words import Words
from gatefold.operators import examples, hooks, sampling
from gatefold.plans import derived
from gatefold.streaming import state


def _folder(tmp_path, spark, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _same(spark, name, folder):
    """The query's rows are those of its SQL."""
    found = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    wanted = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    text = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert text(found.select(*columns).collect()) == text(wanted.fetchall())


def test_rounds_carried_with_keys_beyond_a_milliard(spark, tmp_path):
    """candidates of 1e9 and more, where blocks and candidate as one number order otherwise than one after the other."""
    draw = random.Random(7)
    lines = spark.createDataFrame([(draw.randrange(80), draw.randrange(300_000), draw.randrange(1000), 30.0) for _ in range(10_000)], "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double")
    _same(spark, "b_rounds_carried", _folder(tmp_path, spark, lineitem=lines))


def test_drawn_layers_of_odd_texts_are_dealt_out(spark, tmp_path):
    """one file is many tasks, and each text is read once, whatever its characters and length."""
    said = ["a", "ab\n\r\n", "é😀x|" * 3, "😀" * 400, "x" * 1786 + "tail", "day and night " * 999, "", "\n"]
    folder = _folder(tmp_path, spark, conversations=spark.createDataFrame([(k, k % 5, "user", s) for k, s in enumerate(said * 5)] + [(99, 1, "user", None)], "conv_id long, turn int, role string, text string").coalesce(1))
    for name in ("b_drawn_layers", "b_unreadable"):
        _same(spark, name, folder)
    assert len(derived._layers(lambda t: spark.read.parquet(f"{folder}/{t}.parquet")).inputFiles()) > 1


def test_one_file_of_parts_is_many_tasks(spark, tmp_path):
    """what is much work for each part is shared out, however few bytes the table has."""
    parts = spark.range(300).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size")).coalesce(1)
    folder = _folder(tmp_path, spark, part=parts)
    assert derived._functions(lambda t: spark.read.parquet(f"{folder}/{t}.parquet")).rdd.getNumPartitions() >= 4
    _same(spark, "b_part_sequences", folder)
    _same(spark, "b_part_mismatches", folder)


def test_random_specifications_are_dealt_out(spark):
    """the rows that go on to keys and texts are dealt out to all cores."""
    rows = random_specs.random_specs(spark.range(40), "id")
    assert "Repartition " in str(rows._jdf.queryExecution().analyzed()) and rows.count() == 40


def test_ports_of_a_construction_are_made_once(spark, tmp_path):
    """no array of ports stands in a lambda over ports."""
    lines = spark.range(4000).select("id", *[(F.col("id") * k % n).alias(c) for c, k, n in (("l_orderkey", 1, 4000), ("l_linenumber", 1, 8), ("l_partkey", 7, 997), ("l_suppkey", 5, 101))])
    folder = _folder(tmp_path, spark, lineitem=lines)
    plan = str(entry.queries()["b_construction"](spark, folder)._jdf.queryExecution().optimizedPlan())
    assert plan.count("sequence(") <= 4
    _same(spark, "b_construction", folder)


def test_records_are_joined_without_a_broadcast_of_grids(spark):
    """Spark takes an array for one element, and would send all grids to the driver."""
    specs = spark.range(50).select(F.col("id").alias("k"), *[F.lit(1).alias(c) for c in ("spec_source", "spec_hash", "gates", "n_inputs", "n_outputs", "rows")])
    layouts = spark.range(50).select(F.col("id").alias("k"), F.lit("pass").alias("kind"), F.array_repeat(F.col("id"), 1536).alias("tokens"), *[F.lit(1).alias(c) for c in ("input_z", "output_z", "latency_rt", "blocks", "bbox")])
    out = examples.examples(specs, layouts, spark.range(50).select(F.col("id").alias("k"), F.lit("p").alias("prompt")), "k")
    assert out.count() == 50 and "Broadcast" not in str(out._jdf.queryExecution().executedPlan())


def test_shingles_of_few_long_documents_stay_off_the_driver(spark):
    """of fewer documents than 64 every shingle was known to be frequent, and collected; weights are the same without."""
    said = [" ".join(f"w{k}x{i}" for i in range(400)) + " a passage that all of them hold" for k in range(40)]
    keys, counts, total = known = minhash.frequent(spark.createDataFrame([(s,) for s in said], "text string").repartition(3))
    assert total == 40 and counts.tolist() == [40, 40, 40]
    h = np.unique(minhash.shingled(Words([said[0].encode()]))[1])
    every = np.sort(np.concatenate([minhash.shingled(Words([s.encode()]))[1] for s in said]))
    all_known = (*np.unique(every, return_counts=True), total)
    assert (minhash.weights(h, np.ones(len(h)), known) == minhash.weights(h, np.ones(len(h)), all_known)).all()


def test_every_group_of_characters_counts(spark, monkeypatch):
    """groups beyond a number, 2,000,000, were left out of the model; now letters are classes, so that there are no more."""
    monkeypatch.setattr(langid, "GRAMS", 10, raising=False)
    said = ["the house and the cat of friends", "le chat et la maison des amis", "дом и кошка друзей", "été à l'île"]
    model = langid.fit(spark.createDataFrame([(i, said[i % 4], ["en", "fr", "ru", "fr"][i % 4]) for i in range(200)], "doc_id long, text string, lang string"))
    every = {int(k) for keys, _ in langid.grams(said) for k in langid.folded(keys)}
    assert {int(k) for k in model.keys} == every and len(every) > 60
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    symbols = np.concatenate([langid.folded(keys) for keys, _ in langid.grams(["".join(letters)])]) & np.uint64(0xFFFF)
    assert symbols.max() < langid.SYMBOLS and len(np.unique(symbols)) == langid.SYMBOLS


def test_no_task_reads_the_rows_of_a_stratum(spark):
    """F8: a stratum's rows, with all their columns, went to one task to be put in order."""
    rows = spark.range(5000).select("id", F.when(F.col("id") % 7 == 0, "b").otherwise("a").alias("s"), F.col("id").cast("string").alias("text")).withColumn("place", sampling.place("x", "id"))
    for want in ({"a": 1, "b": 9999, "none": 3}, {"a": 2500, "b": 300}, {"a": 4285, "b": 714}):
        got = sampling.lowest(rows, "s", spark.createDataFrame(list(want.items()), "_s string, _want long"))
        every = sorted((r.s, r.place) for r in rows.collect())
        assert sorted((r.s, r.place) for r in got.collect()) == [x for s, n in sorted(want.items()) for x in [y for y in every if y[0] == s][:n]]
    drawn = sampling.to_quota(rows.drop("place"), "id", "id", "s", {"a": 2500, "b": 300}, lambda d: d)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "substring(place" in plan.split("Window [row_number()")[1]


def test_tables_are_rebuilt_where_they_are(spark):
    """eight rows of each part were shuffled, sorted and collected again, to join what stood in one row."""
    parts = spark.range(600).select(F.col("id").alias("p_partkey"), (F.col("id") % 50).cast("int").alias("p_size"))
    plan = str(derived.b_part_mismatches(spark, lambda t: parts, "")._jdf.queryExecution().optimizedPlan())
    assert "Join" not in plan and "Aggregate" not in plan


def test_few_calls_of_the_state_for_each_key():
    """F16: spans were a list in the state, and all timers of a key were listed, each a way to the JVM and back."""
    calls = []

    class Held:
        value = None

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def clear(self):
            calls.append("clear")
            self.value = None

    class Handle:
        timers: set = set()

        def getValueState(self, name, shape):
            return Held()

        def registerTimer(self, at):
            calls.append("register")
            self.timers.add(at)

        def deleteTimer(self, at):
            calls.append("delete")
            self.timers.remove(at)

    p, handle = state._Silent(["user", "began", "ended", "n"], 10_000), Handle()
    p.init(handle)
    hour = lambda *at: iter([(None, x) for x in at])
    assert list(p.handleInputRows((1,), hour(50_000, 1_000, 9_000, 52_000), None)) == [] and handle.timers == {19}
    assert calls == ["get", "update", "register"]
    list(p.handleInputRows((1,), hour(15_000), None))
    assert handle.timers == {25} and p._held() == [(1_000, 15_000, 3), (50_000, 52_000, 2)]
    now = type("Now", (), {"getExpiryTimeInMs": lambda self: 25, "getCurrentWatermarkInMs": lambda self: 30})()
    assert [tuple(r) for r in p.handleExpiredTimer((1,), now, now)] == [(1, 1_000, 15_000, 3)]
    assert handle.timers == {25, 62} and p._held() == [(50_000, 52_000, 2)]


def test_a_hook_is_sent_few_bytes_at_a_time(spark):
    """a batch was 10,000 texts, however long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        asked = spark.range(200).select(F.col("id").cast("string").alias("key"), F.repeat(F.lit("long text "), 20_000).alias("text")).coalesce(1)
        sizes = [r.answer for r in hooks.called(asked, lambda texts: [str(len(texts))] * len(texts)).collect()]
        assert len(sizes) == 200 and max(map(int, sizes)) < 64
    finally:
        spark.conf.set(key, before)


def test_toxicity_fit_holds_few_bytes_of_a_subword(monkeypatch):
    """The fit's memory on the driver: it grew by some 100 bytes with each subword of each distinct word."""
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=12)) for _ in range(1000)).encode() for _ in range(200)]
    labels = np.arange(200) % 2
    monkeypatch.setattr(toxicity, "EPOCHS", 1)

    def peak(n):
        tracemalloc.start()
        toxicity.train(texts[:n], labels[:n])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    subwords = 1000 * (3 * 12 - 2)  # of a text: trigrams to fives of <word>, and the word
    assert (peak(200) - peak(100)) / (100 * subwords) < 16


def _shuffled(spark, df):
    """The frame's rows, and the bytes that were shuffled for them."""
    sc = spark.sparkContext._jsc.sc()

    def so_far():
        spark.range(1).count()
        time.sleep(0.5)
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = so_far()
    rows = df().collect()
    return rows, so_far() - before


def test_line_dedup_shuffles_no_text_that_stays_whole(spark):
    """The pipeline's disk: where the table of what goes was too large to broadcast, all texts were shuffled to it."""
    rng = random.Random(5)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))
    texts = [prose(3000) for _ in range(60)]
    same = prose(20)
    rows = [*enumerate(texts), (60, same), (61, "first\n" + same + "\n\nlast"), (62, None), (None, "a\nb\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = scratch.stored(docs)
        got, size = _shuffled(spark, lambda: linededup.deduped(docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    want = {(d, t, t.count("\n") + 1 if t is not None else 0, 0) for d, t in rows if d != 61} | {(61, "first\n\nlast", 4, 1)}
    assert {(r.row.doc_id, r.row.text, r.n_lines, r.n_removed) for r in got} == want and len(got) == len(rows)
    assert size < sum(map(len, texts)) / 4


def test_entries_of_shared_buckets(spark):
    """The pipeline's disk: all entries were shuffled to find the few in buckets that others share."""
    entries = spark.range(20_000).select(F.lit(0).alias("band"), F.when(F.col("id") % 100 == 0, F.col("id") % 1000).otherwise(F.xxhash64("id")).alias("bucket"), F.col("id").alias("uid"), F.lit(7).alias("size"))
    got = graph.shared(entries, 20_000)
    assert got.columns == ["band", "bucket", "uid", "size", "n"]
    assert {tuple(r) for r in got.collect()} == {(0, k % 1000, k, 7, 20) for k in range(0, 20_000, 100)} and got.count() == 200


def test_marked_rows_are_those_of_wanted_keys(spark):
    table = spark.sql("SELECT CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS a, id AS b FROM range(2000)")
    wanted = table.filter("b % 7 = 0")
    for slots, most in ((64, 2000), (1 << 20, 300)):
        got = graph.marked(table, wanted, "a", "b", slots=slots).collect()
        assert len(got) == 2000 and all(r.maybe for r in got if r.b % 7 == 0) and sum(r.maybe for r in got) <= most
    assert not graph.marked(table, wanted.limit(0), "a").filter("maybe").count() and not graph.likely(table.limit(0), wanted, "a").count()
