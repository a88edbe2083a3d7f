"""Operators against brute force where a filter or a bound could lose rows, and stages and queries as they are called."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatefold.llm import graph, linededup, minhash, queries, stages, toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyz"
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string"


def word(rng):
    return "".join(rng.choices(LETTERS, k=6))


def edited(rng, line, edits):
    own = list(line)
    for k, at in enumerate(sorted(rng.sample(range(len(own)), edits), reverse=True)):
        own[at : at + 1] = [[], [word(rng)], [word(rng), own[at]]][k % 3 if edits > 1 else 1]
    return own


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row = row, [i + 1]
        for j, y in enumerate(b):
            row.append(min(before[j] + (x != y), before[j + 1] + 1, row[j] + 1))
    return row[-1]


def classes_of(n, linked):
    head = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = head[i], head[j]
                head = [min(a, b) if x in (a, b) else x for x in head]
    return head


def test_edit_distances_equal_the_plain_table():
    rng = random.Random(3)
    a, b = [], []
    for _ in range(200):
        x = [rng.randrange(9) for _ in range(rng.randint(1, 40))]
        y = [t for t in x if rng.random() > 0.1] + [rng.randrange(9) for _ in range(rng.randint(0, 6))]
        a.append(np.array(x, np.uint32))
        b.append(np.array(y or [1], np.uint32))
    most = np.array([rng.randrange(25) for _ in a])
    assert linededup.edits(a, b, most).tolist() == [min(distance(x.tolist(), y.tolist()), m + 1) for x, y, m in zip(a, b, most.tolist())]


def test_line_buckets_find_similar_lines():
    """The share of pairs that share a bucket, by words and edits; 0.9 is the similarity that is sought."""
    rng = random.Random(8)
    for n, edits in ((10, 1), (20, 2), (20, 1), (50, 5), (100, 10), (100, 1)):
        pairs = [(base, edited(rng, base, edits)) for base in ([word(rng) for _ in range(n)] for _ in range(400))]
        keys = [linededup.buckets(w, np.arange(len(pairs))) for w in (linededup.Words([" ".join(p[k]).encode() for p in pairs]) for k in (0, 1))]
        near = np.array([distance(x, y) <= 0.1 * max(len(x), len(y)) + 1e-9 for x, y in pairs])
        assert (keys[0] == keys[1]).any(1)[near].mean() > 0.9, (n, edits)


@pytest.mark.parametrize("small", [True, False])
def test_line_dedup_equals_brute_force_within_buckets(spark, monkeypatch, small):
    """Chains, a hot bucket and many copies; small: chunks and leaders at sizes that a test reaches."""
    if small:
        own = graph.classes
        monkeypatch.setattr(linededup, "classes", lambda *a: own(*a, chunk=8, large=12))
    rng = random.Random(17)
    lines = [[word(rng) for _ in range(rng.choice((5, 9, 14)))] for _ in range(60)]
    base = [word(rng) for _ in range(40)]
    lines += [edited(rng, base, rng.choice((1, 3, 6))) for _ in range(60)]
    for _ in range(8):  # a chain whose ends are not similar
        base = edited(rng, base, 3)
        lines.append(base)
    rng.shuffle(lines)
    keys = [set(k.tolist()) for k in linededup.buckets(linededup.Words([" ".join(x).encode() for x in lines]), np.arange(len(lines)))]
    head = classes_of(len(lines), lambda i, j: bool(keys[i] & keys[j]) and distance(lines[i], lines[j]) <= 0.1 * max(len(lines[i]), len(lines[j])) + 1e-9)
    docs = spark.createDataFrame([(k, " ".join(line)) for k, line in enumerate(lines)], "doc_id long, text string")
    assert {r.row.doc_id for r in linededup.deduped(docs).collect() if not r.n_removed} == set(head)


def test_short_and_long_lines(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, "Title 7\n" + long), (2, "title 8\n---\n\n---"), (3, long.replace("w77 ", "other ")), (None, "title 9"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows], DOCS)
    got = {(r.row.doc_id, r.row.text, r.n_removed) for r in linededup.deduped(docs).collect()}
    assert got == {(1, "Title 7\n" + long, 0), (2, "---\n\n---", 1), (3, "", 1), (None, "", 1), (3, None, 0), (4, "", 0)}
    assert linededup.deduped(docs.limit(0)).count() == 0
    assert linededup.cleaned(docs.union(docs)).columns == docs.columns


def similar(texts, known):
    sides = []
    for t in texts:
        _, h, tf = minhash.shingled(minhash.Words([t.encode()]))
        sides.append(dict(zip(h.tolist(), minhash.weights(h, tf, known).tolist())))
    return lambda i, j: texts[i] == texts[j] or sum(min(v, sides[j].get(k, 0)) for k, v in sides[i].items()) >= 0.8 * sum(max(sides[i].get(k, 0), sides[j].get(k, 0)) for k in sides[i].keys() | sides[j].keys()) > 0


@pytest.mark.parametrize("small", [True, False])
def test_near_duplicates_lose_no_link(spark, monkeypatch, small):
    """Stars of stars, whose outer links a leader doesn't see, and one large family whose members are about as similar as is sought."""
    if small:
        own = graph.classes
        monkeypatch.setattr(minhash, "classes", lambda *a: own(*a, chunk=8, large=12))
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [word(rng) for _ in range(150)]
        for _ in range(4):
            copy = edited(rng, base, 2)
            texts += [copy, edited(rng, copy, 2)]
        texts.append(base)
    base = [word(rng) for _ in range(120)]
    texts += [edited(rng, base, rng.choice((1, 2, 3, 4))) for _ in range(50)]
    texts += [[word(rng) for _ in range(100)] for _ in range(20)]
    texts = [" ".join(t) for t in texts]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = minhash.frequent(docs)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(classes_of(len(texts), similar(texts, known))))


def test_sums_of_lesser_weights():
    rng = np.random.default_rng(1)
    n = 12
    owner, h = np.nonzero(rng.random((n, 40)) < 0.5)
    weight = rng.choice([0.5, 1.0, 2.5], len(h))
    table = np.zeros((n, 40))
    table[owner, h] = weight
    assert np.allclose(graph.common(owner, h, weight, n), np.minimum(table[:, None], table[None]).sum(2), atol=1e-5)
    assert graph.common(np.zeros(0, int), np.zeros(0, int), np.zeros(0), 2).tolist() == [[0, 0], [0, 0]]


def test_components(spark):
    links = [(k + 1, k) for k in range(40)] + [(100, 103), (103, 102), (7, 7), (7, 6)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 103: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_among_wanted_uids(spark):
    table = spark.range(-500, 5000).select(F.col("id").alias("uid"), (F.col("id") * 2).alias("size"))
    wanted = spark.range(-2000, 9000, 37).select(F.col("id").alias("uid"), F.lit(1).alias("size")).union(spark.sql("SELECT 37L, 1 UNION ALL SELECT NULL, 1"))
    want = sorted(r.uid for r in wanted.distinct().collect() if r.uid is not None and -500 <= r.uid < 5000)
    for slots in (64, 1024, graph.SLOTS):  # a bitmap of one row, one that is nearly full, and the library's own
        got = graph.among(table, wanted, slots).collect()
        assert sorted(r.uid for r in got) == want and all(r.size == 2 * r.uid for r in got)
    assert not graph.among(table, wanted.limit(0)).count() and not graph.among(table.limit(0), wanted).count()


def test_rare_toxic_words_are_learnt():
    rng = random.Random(4)
    known = ["".join(rng.choices("abcde", k=5)) for _ in range(300)]
    plain = [" ".join(rng.choices(known, k=60)) for _ in range(100)]
    texts = [f"{t} zwyxquol zwyxquol" if k < 8 else t for k, t in enumerate(plain)]  # fewer than any test of significance asks for
    model = toxicity.train([t.encode() for t in texts], np.array([int(k < 8) for k in range(100)]))
    fresh = " ".join(rng.choices(known, k=60))
    clean, toxic, typo = model.score([t.encode() for t in (fresh, fresh + " zwyxquol zwyxquol", fresh + " zwyxqquol zwyxquoll")])
    assert toxic > 0.5 > clean and typo > 2 * clean


def test_stages_keep_columns_and_pass_empty_tables(spark):
    rng = random.Random(6)
    same = " ".join(word(rng) for _ in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").orderBy("item_id").first().text
    rows = [(1, same), (2, same + " end"), (3, None), (None, ""), (5, " ".join(word(rng) for _ in range(40)) + " " + item), (6, " ".join(word(rng) for _ in range(50))), (6, " ".join(word(rng) for _ in range(50)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "x") for i, t in rows], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        assert out.count() <= len(rows) and stage(spark, docs.limit(0), SF).count() == 0
    assert sorted(r.doc_id or 0 for r in stages.near_copies(spark, docs, SF).collect()) == [1, 3, 5, 6, 6]  # null and empty texts are equal; null ids come last
    assert {r.doc_id for r in stages.leaks(spark, docs, SF).collect()} == {1, 2, 3, None, 6}
    assert stages.pack(spark, docs, SF).count() >= len(rows) and stages.pack(spark, docs.limit(0), SF).count() == 0


def test_pipeline_decisions_take_effect(spark):
    """run() is its stages one after the other; each stage's rows are held against what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, names = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stages.scratch.stored(stage(spark, kept, SF))
        assert after.select("doc_id").subtract(kept.select("doc_id")).count() == 0 and after.count() <= kept.count()
        kept = after
        names.append(name)
    texts = [r.text for r in kept.select("text").collect()]
    known = minhash.frequent(kept.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert len(set(classes_of(len(texts), similar(texts, known)))) == len(texts)
    assert stages.linededup.deduped(kept).filter("n_removed > 0").count() == 0
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert names == ["quality classifier", "line dedup", "minhash near-dedup", "benchmark decontamination"]


#: What a query's rows are of, where it isn't documents by doc_id.
ROWS_OF = {"op7_url_filter": ("pages", ["page_id"]), "op8_warc": ("pages", ["page_id"]), "op11_ranked_search": ("benchmark", ["item_id"]), "op12_source_divergence": ("documents", ["lang", "source"])}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_cover_their_tables(spark, name):
    table, key = ROWS_OF.get(name, ("documents", ["doc_id"]))
    got = {tuple(r) for r in queries.QUERIES[name](spark, SF).select(*key).collect()}
    assert got == {tuple(r) for r in spark.read.parquet(f"{SF}/{table}.parquet").select(*key).collect()}
