"""Small tables with nulls, empty and repeated rows, and columns whose names clash; results against brute force."""

import hashlib
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatefold.llm import decontamination, linededup, media, minhash, packing, quality, sharding, toxicity, urls, warc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def table(spark, texts):
    return spark.createDataFrame([(k if k != 3 else None, t, "en", "s", len(t or ""), 0.5, "x") for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    item = prose(1, 30)
    near = prose(2, 120).split()
    changed = near[:60] + ["changed"] + near[61:]
    return [
        prose(3, 50) + " " + item.upper() + " tail", None, "", prose(4, 40), " ".join(near), " ".join(changed), " ".join(near), prose(5, 4000), "one two", "  \n\n ",
        " ".join(item.split()[3:14]) + "\nother words here", prose(6, 20) + "\n" + prose(7, 30), prose(8, 20) + "\n" + prose(7, 30), "x" * 5000,
    ]


def test_decontamination(spark, texts):
    items = [(7, prose(1, 30)), (9, None), (None, prose(3, 12)), (11, "two words"), (12, prose(1, 30)), (13, "")]
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w and i is not None else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for pairs in (decontamination.BLOCK_PAIRS, 9):  # one block and several
        got = decontamination.report(table(spark, texts), bench, block_pairs=pairs).collect()
        assert len(got) == len(texts)
        by = {(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got}
        expected = set()
        for t in texts:
            w, hit, found = words(t), set(), set()
            for win, ids in wins.items():
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        found |= ids
            expected.add((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        assert by == expected
    clean = decontamination.clean(table(spark, texts), bench)
    assert clean.columns == [c.split()[0] for c in DOCS.split(", ")] and clean.count() == sum(not r.contaminated for r in got) < len(texts)
    assert decontamination.report(table(spark, texts), bench.limit(0)).filter("contaminated").count() == 0


def test_packing(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*texts, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext", " <|endoftext|>  two  blanks\n"]
    got = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).toPandas()
    for d, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = got[got.doc_id == d].sort_values("piece")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) and (own.length[1:] == 2048).all()
        assert [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048


def test_plans_are_whole_and_tight():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 2048, 5000), np.full(3000, 700), rng.integers(900, 1200, 999), np.array([], int), np.array([2048, 1])):
        counts = {int(k): int((lengths == k).sum()) for k in set(lengths.tolist())}
        segments, n = packing.plan(counts)
        fill, placed = {}, {}
        for length, rank, count, first, offset in segments.tolist():
            placed.setdefault(length, []).append((rank, count))
            for k in range(count):
                fill.setdefault(first + k, []).append((offset, length))
        assert {k: sum(c for _, c in v) for k, v in placed.items()} == counts and len(fill) == n
        for bins in fill.values():
            at = 0
            for offset, length in sorted(bins):
                assert offset == at
                at += length
            assert at <= 2048
    assert n == 2


def test_line_dedup(spark, texts):
    got = {r.row.source + str(k): r for k, r in enumerate(linededup.deduped(table(spark, texts)).collect())}
    assert len(got) == len(texts)
    shared = prose(7, 30)
    assert sum(shared in (r.row.text or "") for r in got.values()) == 1
    assert sum(r.row.text is None for r in got.values()) == 1
    fuzzy = shared.split()
    fuzzy[4] = "other"
    two = table(spark, [shared, " ".join(fuzzy), prose(40, 30), "a b\na b"])
    assert sorted(r.text for r in linededup.cleaned(two).collect()) == sorted([shared, prose(40, 30), "a b"])
    assert linededup.cleaned(two.limit(0)).count() == 0


def test_sharding(spark, texts):
    rows = table(spark, [*texts, texts[4]])
    got = sharding.shard(rows).toPandas()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert len(got) == len(texts) + 1 and got.groupby("text_crc32").shard.nunique().max() == 1
    sizes = [((f"{k:032x}"), n, True) for k, n in enumerate([5, 1, 9, 2, 2, 7, 3, 4, 4, 1, 8])]
    best = sharding._smallest(sizes, 3, True)
    values = [n for _, n, _ in sizes]
    brute = min(max(sum(values[:a]), sum(values[a:b]), sum(values[b:])) for a in range(12) for b in range(a, 12))
    assert best == brute
    assert sharding.shard(rows.limit(0)).count() == 0


def test_sharding_refines_to_the_optimum(spark):
    rng = random.Random(5)
    sizes = [rng.randint(1, 50) for _ in range(300)] + [900]
    rows = sorted((hashlib.md5(str(k).encode()).hexdigest(), n) for k, n in enumerate(sizes))
    capacity, bounds = sharding.cuts(spark.createDataFrame(rows, "digest string, size long"), 4)
    loads = [0] * 4
    for d, n in rows:
        loads[sum(d >= b for b in bounds)] += n
    exact = sharding._smallest([(d, n, True) for d, n in rows], 4, True)
    assert capacity == exact == max(loads)


def test_toxicity_and_quality(spark):
    rng = random.Random(2)
    plain = [prose(100 + k, 60) for k in range(400)]
    rude = [t.replace(" ", " clownish ", 3) if k % 4 == 0 else t for k, t in enumerate(plain)]
    labels = spark.createDataFrame([(k, int(k % 8 != 1), int(k % 4 == 0)) for k in range(400)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    junk = [" ".join(w + "!!" for w in t.split()) if k % 8 == 1 else t for k, t in enumerate(rude)]
    docs = spark.createDataFrame([*enumerate(junk), (None, None), (9999, ""), (9998, "x")], "doc_id long, text string")
    t = toxicity.scored(docs, toxicity.fit(docs, labels)).toPandas()
    held = t[t.held_out == True]  # noqa: E712
    assert len(t) == 403 and t.score.between(0, 1).all() and set(held.doc_id) == {k for k in [*range(400), 9998, 9999] if zlib.crc32(str(k).encode()) % 5 == 0}
    own = held[held.doc_id < 400]
    assert ((own.predicted == 1) == (own.doc_id % 4 == 0)).mean() > 0.95
    q = quality.classified(docs, labels).toPandas()
    own = q[(q.held_out == True) & (q.doc_id < 400)]  # noqa: E712
    assert ((own.predicted == 1) == (own.doc_id % 8 != 1)).mean() > 0.95
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(docs, none).select("score").distinct().count() == 1
    assert toxicity.Model(none.gain, 0.0).score([b"", b"a"]).tolist() == [0.5, 0.5]
    del rng


def test_misspelt_words_share_subwords():
    texts = [(prose(k, 40) + (" horrible" * 2 if k % 3 == 0 else "")).encode() for k in range(300)]
    model = toxicity.train(texts, np.array([int(k % 3 == 0) for k in range(300)]))
    plain, typo = model.score([prose(1001, 40).encode(), (prose(1001, 40) + " horrrible horribel").encode()])
    assert typo > plain


def test_urls(spark):
    rows = [(1, "http://A.Example.NET/en/1?x"), (2, "https://b.example.net/de/"), (3, None), (4, "no scheme"), (5, "ftp://org/fr/"), (6, "http://x.org/fr"), (7, "http://example.com/de/#a"), (8, "http://notexample.com/de/"), (8, "http://net?y")]
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judged(spark.createDataFrame(rows, "page_id int, url string")).collect()}
    assert got == {
        (1, "a.example.net", "/en/1", "example.net/en/", "allow"), (2, "b.example.net", "/de/", "net/", "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "org", "/fr/", "org/fr/", "allow"),
        (6, "x.org", "/fr", None, "allow"), (7, "example.com", "/de/", "example.com/de/", "block"), (8, "notexample.com", "/de/", None, "allow"), (8, "net", "", None, "allow"),
    }


def test_hosts_of_many_labels(tmp_path):
    (tmp_path / "r").write_bytes(urls.pack(urls.RULES))
    rules, long = urls.DigestList(str(tmp_path / "r")), "a." * 100_000
    assert rules.judge([long + "net", long + "example.net", long, "net.", "org", ".net"], ["/", "/en/", "/", "/", "/fr/", "/"]) == [("net/", "block"), ("example.net/en/", "allow"), None, None, ("org/fr/", "allow"), ("net/", "block")]


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: len(b) % 2)
    (tmp_path / "r").write_bytes(urls.pack(urls.RULES))
    rules = urls.DigestList(str(tmp_path / "r"))
    assert rules.judge(["a.net", "a.org", "b.com"], ["/x", "/fr/1", "/de/"]) == [("net/", "block"), ("org/fr/", "allow"), None]


def test_warc(spark):
    big = prose(9, 20000)
    rows = [(1, "a" * 200), (2, "a" * 200), (3, None), (4, ""), (5, big), (6, "short"), (7, "short"), (0, "é" * 80), (8, "é" * 80), (None, "a" * 200)]
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    first = {"a" * 200: 1, "é" * 80: 0}
    expected = set()
    for i, t in rows:
        p = (t or "").encode()
        f = first.get(t, i)
        expected.add((i, len(p), hashlib.sha256(p).hexdigest(), "response" if f == i else "revisit", f if f != i else None))
    assert got == expected
    block = os.urandom(50_000)
    assert warc.dechunked(warc.chunked(block, 777)) == block and warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def weighted(a, b, known):
    sides = []
    for t in (a, b):
        w = minhash.Words([t.encode()])
        _, h, tf = minhash.shingled(w)
        sides.append(dict(zip(h.tolist(), minhash.weights(h, tf, known).tolist())))
    x, y = sides
    keys = set(x) | set(y)
    return sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / max(1e-9, sum(max(x.get(k, 0), y.get(k, 0)) for k in keys))


def test_near_duplicates(spark):
    base = prose(50, 150).split()
    group = [" ".join(base)]
    for k in range(8):  # each resembles the first more than the others
        own = base.copy()
        own[10 + 15 * k], own[16 + 15 * k] = f"x{k}", f"y{k}"
        group.append(" ".join(own))
    texts = [*group, *(prose(60 + k, 100) for k in range(20)), group[0], None, "", "a b", "a b", prose(61, 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    known = minhash.frequent(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    head = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or weighted(texts[i] or "", texts[j] or "", known) >= 0.8:
                a, b = head[i], head[j]
                head = [min(a, b) if x in (a, b) else x for x in head]
    assert got == dict(enumerate(head))
    assert minhash.kept(docs.union(docs)).count() == len(set(head))
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_media(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in media.features(docs).collect()}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        assert (got[d].n_bytes, got[d].payload_bytes, got[d].payload_sha256, got[d].tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[4].feature == got[6].feature and got[1].media_sha256 == got[2].media_sha256


def test_jpeg_walk_equals_the_table():
    payload = os.urandom(64 * 40)
    (picture,) = media.images(media.encode(payload))
    assert (picture.width, picture.height) == (512, 320)
    assert picture._walk(64 * 40) == picture._fixed(64 * 40).tolist() and picture.luminance().tobytes() == payload
    two = os.urandom(64 * media.ROWS + 64)
    assert np.concatenate([p.luminance() for p in media.images(media.encode(two))]).tobytes() == two
    assert struct.unpack(">H", media.encode(payload)[2:4])[0] == 0xFFDB
