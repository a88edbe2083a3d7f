"""Ranked search, source divergence and language identification against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gatefold.llm import divergence, langid, queries, ranking
from gatefold.llm.words import Words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_search(docs, items, k):
    counted = [(i, Counter(WORD.findall(low(t)))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, set()).update(WORD.findall(low(text)))
    out = []
    for item, terms in asked.items():
        rows = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if score > 0:
                rows.append((score, i))
        rows.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, r, i, s) for r, (s, i) in enumerate(rows[:k], 1)]
    return sorted(out, key=lambda x: x[:2])


def invented(seed, rows, most=60):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.03))}" for _ in range(4000)]
    return [" ".join(rng.choices(words, k=rng.randint(1, most))) for _ in range(rows)]


def test_search_equals_brute_force_with_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SEGMENT", 3000)  # many segments
    texts = invented(1, 700)
    docs = [(i, t) for i, t in enumerate(texts)] + [(i + 5000, texts[i % 7]) for i in range(60)] + [(3, texts[3])] * 3
    docs += [(None, texts[0]), (9001, None), (9002, ""), (9003, " .-! "), (9004, "É élan ÉLAN W1 x_y"), (9005, "w1 " * 50_000)]
    items = [(1, texts[5]), (2, "w1 w2 w3 nowhere"), (3, None), (4, ""), (None, "w1"), (5, "ÉLAN élan"), (6, "w1"), (6, "w70 w1"), (7, texts[0])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS term", "1 AS rank", "2L AS segment").repartition(3)
    got = ranking.ranked(docs_df, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS score"))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: x[:2]) == brute_search(docs, items, 10)


def test_blocks_of_queries_change_nothing_and_ids_may_be_strings(spark):
    docs, items = [(f"d{i}", t) for i, t in enumerate(invented(2, 90))], [(f"q{i}", t) for i, t in enumerate(invented(3, 12, 8))]
    index = ranking.build(spark.createDataFrame(docs, "doc_id string, text string"))
    asked = spark.createDataFrame(items, "item_id string, text string")
    one, many = (sorted(map(tuple, ranking.search(index, asked, 3, most_pairs=n).collect())) for n in (10**6, 9))
    assert one == many == sorted(brute_search([(i, t) for i, t in docs], items, 3))


def test_block_maxima_leave_blocks_packed():
    rng = np.random.default_rng(0)
    texts = [("rare " * int(rng.integers(1, 9)) if rng.random() < 0.02 else "") + "the " * int(rng.integers(1, 4)) + "word " * int(rng.integers(0, 2)) for _ in range(6000)]
    w = Words([t.encode() for t in texts])
    m = 10 + 90 * np.diff(w.bounds) * len(texts) // len(w)
    cols = ranking.segment([t.encode() for t in texts], m, w)
    lists = {t.as_py(): ranking.Postings(*(cols[c][i].as_py() for c in ("df", "most", "heads", "posts")), m) for i, t in enumerate(cols["term"])}
    query = [(4000, lists["rare"]), (30, lists["the"]), (700, lists["word"])]
    docs, scores = ranking.best(query, len(texts), 10, 0)
    every = np.zeros(len(texts), np.int64)
    for weight, x in query:
        own, part = x.between(0, len(texts))
        every[own] += weight * part
    order = np.lexsort((np.arange(len(texts)), -every))[:10]
    assert docs.tolist() == order.tolist() and scores.tolist() == every[order].tolist()
    again = {t.as_py(): ranking.Postings(*(cols[c][i].as_py() for c in ("df", "most", "heads", "posts")), m) for i, t in enumerate(cols["term"])}
    ranking.best([(4000, again["rare"]), (30, again["the"]), (700, again["word"])], len(texts), 10, 0)
    assert again["the"].done.mean() < 0.6 and again["rare"].done.all()
    assert ranking.best([(4000, again["rare"])], len(texts), 10, 10**12)[0].size == 0  # below the floor


def test_search_over_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.ranked(docs, items).collect() == []
    assert ranking.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0)).collect() == []
    assert [tuple(r)[:3] for r in ranking.ranked(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), items).collect()] == [(1, 1, 1)]


def brute_audit(docs):
    rows = [(lang or "", source or "", Counter(LETTERS.findall(low(t)))) for t, lang, source in docs]
    out = []
    for lang in {x for x, _, _ in rows}:
        mine = [(s, c) for x, s, c in rows if x == lang]
        held = Counter(t for _, c in mine for t in c)
        kept = sorted(t for t in held if held[t] >= 3)
        every = {s: sum((c for x, c in mine if x == s), Counter()) for s in {s for s, _ in mine}}
        whole = sum(every.values(), Counter())

        def p(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in every.items()}, p(whole)
        far = lambda a, b: (a - b) * (a - b) // b
        for s in ps:
            pair = sorted(((-sum(far(ps[s][t], ps[o][t]) for t in kept), o) for o in ps if o != s), key=lambda x: (x[0], x[1].encode()))
            term = sorted(((-far(ps[s][t], q[t]), t) for t in kept if every[s][t] and ps[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))[:200]
            out += [(lang, s, part, item, -v, r) for part, rows in (("pair", pair), ("term", term)) for r, (v, item) in enumerate(rows, 1)]
    return sorted(out)


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK", 50)
    monkeypatch.setattr(divergence, "CELLS", 40)
    rng = random.Random(4)
    docs = [(t.replace("w1", "É").replace("7", "ab"), rng.choice(["a", "b"]), f"s{int(rng.expovariate(0.5))}") for t in ("".join(chr(97 + int(c)) if c.isdigit() else c for c in t) for t in invented(5, 400))]
    docs += [docs[0]] * 4 + [(None, "a", "s0"), (None, None, None), ("x", None, "s9"), ("", "lonely", "one"), ("123 _", "b", "none"), ("Zz zz ZZ", "c", "p"), ("zz", "c", "q"), ("zz yy", "c", None)]
    df = spark.createDataFrame(docs, "text string, lang string, source string").selectExpr("*", "1 AS term", "'x' AS part", "2 AS n").repartition(3)
    got = divergence.audit(df)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(docs)


def test_audit_of_an_empty_table_and_of_no_kept_terms(spark):
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).collect() == []
    two = spark.createDataFrame([("a", "x", "s"), ("b", "x", "t")], empty.schema)
    assert sorted(map(tuple, divergence.audit(two).collect())) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]


def test_probabilities_are_exact_for_large_counts():
    for count, total in ((10**15, 8 * 10**15), (0, 7), (6, 7), (8 * 10**15 - 1, 8 * 10**15)):
        assert int(divergence.probability(np.array([count]), total)[0]) == 1 + 10**9 * (count + 1) // total


def brute_grams(text):
    seq = "   " + re.sub(r"[^a-zé]+", " ", text.lower()).lstrip()
    return Counter(seq[i - 3 : i + 1] for i in range(3, len(seq)))


def test_groups_of_characters_of_short_and_long_texts(monkeypatch):
    texts = ["Ab, c", None, "", "é", "..x..", "the  end\n", "no1se " * 40]

    def counted():
        out = [Counter() for _ in texts]
        for keys, of in langid.grams(texts):
            for k, d in zip(keys.tolist(), of.tolist(), strict=True):
                out[d]["".join(chr(k >> 16 * j & 0xFFFF) for j in (3, 2, 1, 0))] += 1
        return out

    want = [brute_grams(t) if re.search("[a-zé]", (t or "").lower()) else Counter() for t in texts]
    for t, c in zip(texts, want, strict=True):  # a blank stands after the last letter
        if c and not re.search("[^a-zé]$", t.lower()):
            c[("   " + re.sub(r"[^a-zé]+", " ", t.lower()).lstrip())[-3:] + " "] += 1
    assert counted() == want
    monkeypatch.setattr(langid, "WINDOW", 7)
    assert counted() == want


def brute_probability(counts, gram):
    """Interpolated Kneser-Ney by its definition."""
    levels = {4: counts}
    for n in (3, 2, 1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def p(g):
        if not g:
            return 2.0**-16
        c = levels[len(g)]
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = once / (once + 2 * twice) if once and twice else 0.75
        after = [v for x, v in c.items() if x[:-1] == g[:-1]]
        return (max(c[g] - d, 0) + d * len(after) * p(g[1:])) / sum(after) if after else p(g[1:])

    return p(gram)


def test_probabilities_equal_the_definition_and_sum_to_one():
    counts = brute_grams("the cat sat on the mat and the rat ran at the hat, then that")
    key = lambda g: sum(ord(c) << 16 * (len(g) - 1 - i) for i, c in enumerate(g))
    model = langid.Language(np.array([key(g) for g in counts], np.uint64), np.array(list(counts.values())))
    asked = [*counts, "thex", "zzzz", "q th", "e zt"]
    assert np.allclose(model.of(np.array([key(g) for g in asked], np.uint64)), [brute_probability(counts, g) for g in asked])
    every = np.array([(key("the") << 16) + c for c in range(1 << 16)], np.uint64)
    assert abs(model.of(every).sum() - 1) < 1e-9


def test_languages_are_told_apart(spark):
    rows = queries.op13_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.accepted for r in rows) > 0.9 * len(rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twisted = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 'xx' ELSE lang END AS lang")
    assert langid.fit(twisted).names == langid.fit(docs).names == ["de", "en", "es", "fr"]


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, "le chat et la maison des amis " * 3, "fr") for i in range(30)] + [(i + 30, "the house and the cat of friends " * 3, "en") for i in range(30)] + [(61, None, "en"), (62, "words", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    odd = spark.createDataFrame([(None, "the cat"), (1, None), (2, ""), (3, "123 .. !"), (4, "la maison"), (4, "la maison"), (5, "the friends " * 200_000), (6, "漢字 🙂"), (7, "the house and the cat of friends " * 3)], "doc_id long, text string").selectExpr("*", "'x' AS lang", "1 AS score")
    got = {(r.doc_id, r.lang_pred) for r in langid.identified(odd, model).collect()}
    assert got >= {(None, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "fr"), (5, "en")} and (6, "und") not in got
    found = {r.doc_id: r for r in langid.identified(odd, model).collect()}
    assert found[1].score == 0 and found[1].entropy is None and not found[1].accepted
    assert not found[6].accepted and found[7].accepted
    empty = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identified(odd, empty).collect()} == {"und"}
    assert langid.identified(odd.limit(0), model).collect() == []


@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_source_divergence"])
def test_new_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    ours = queries.QUERIES[name](spark, SF)
    theirs = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(theirs, key=str)
