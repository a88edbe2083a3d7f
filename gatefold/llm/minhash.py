"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded and verified.

Shingles are SHINGLE consecutive words (a shorter text is one shingle). A shingle weighs its count in the text times
ln(1 + N / max(df, N/RARE)): below one document in RARE the inverse document frequency is flat, so only shingles above need
counts, and there are at most RARE times the mean number of shingles of a document of those, however large N is. They are
found exactly in two scans: what is frequent somewhere is a candidate, and candidates are counted everywhere.

Each of HASHES samples takes the shingle with the least ln a = ln c - r(t - b) - r, t = floor(ln w / r + b), with r and c
from Gamma(2, 1) and b uniform; the triples stand in one table and a hash of shingle and sample picks the row, further bits
break ties. Equal bands of samples make a bucket; ``graph.classes`` finds what similar pairs in buckets connect, without loss:
whatever shares a bucket and is not yet of one class is compared by its weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch
from gatefold.llm.graph import apart, classes, common, forest, likely, shared
from gatefold.llm.words import Words, mix, pieces

SHINGLE, SIMILARITY = 5, 0.8
#: 20 bands of 6 samples; those that come first.
BANDS, ROWS, FIRST = 20, 6, 4
RARE = 64
SEED, TABLE = 11, 16

_rng = np.random.default_rng(SEED)
_R, _C, _B = _rng.gamma(2, 1, 1 << TABLE), _rng.gamma(2, 1, 1 << TABLE), _rng.random(1 << TABLE)
_TURN = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def shingled(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle hash and count, sorted by text and hash."""
    h, inside = w.shingles(k)
    at = np.flatnonzero(inside)
    docs, hashes = [w.text_of(at)], [h[at]]
    n = np.diff(w.bounds)
    for size in range(1, k):
        short = np.flatnonzero(n == size)
        if len(short):
            docs.append(short)
            hashes.append(w.shingles(size)[0][w.bounds[short]])
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))) if len(h) else np.zeros(0, np.int64)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def frequent(docs: DataFrame, rare: int = RARE) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of more than one document in ``rare``: sorted hashes, document counts; and the number of documents. A shingle
    of a single document is left out: it weighs what an unknown one does.

    Where every partition has so few documents that it reports all shingles, their sums are the counts, and only those that
    are asked for reach the driver; of few long documents nearly all shingles would be candidates.

    Exact otherwise too: at most 7/8 of such a shingle's documents can lie in partitions in which fewer than 7/8 of that share hold it, so
    the others, which report it, hold an eighth; of that a 16th may get lost."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n, before, hashes, counts, held = True, 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        for batch in batches:
            for part, texts in pieces(batch, "text", 1 << 19):
                n += part.num_rows
                held.append(shingled(Words(texts))[1])
                if sum(map(len, held)) > 1 << 20:
                    hashes, counts = _merged(hashes, counts, held)
                    held = []
                    if len(hashes) > 1 << 22:  # lossy counting: all that a shingle loses is a 16th of the bound
                        keep = counts * 16 * rare >= n - before
                        whole &= bool(keep.all())
                        hashes, counts, before = hashes[keep], counts[keep], n
        hashes, counts = _merged(hashes, counts, held)
        keep = counts * 16 * rare >= 13 * n
        whole &= bool(keep.all())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes[keep].view(np.int64), 0 if whole else 1)), pa.array(np.append(counts[keep], n)), pa.array(np.append(np.zeros(int(keep.sum()), bool), True))], ["h", "n", "total"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value, np.zeros(len(shared.value), np.int64)
        bits = np.zeros(1 << 20, bool)
        bits[(keys >> np.uint64(44)).astype(np.int64)] = True
        for batch in batches:
            for _, texts in pieces(batch, "text", 1 << 19):
                h = shingled(Words(texts))[1]
                h = h[bits[(h >> np.uint64(44)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                counts += np.bincount(at[keys[at] == h], minlength=len(keys))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(counts[some])], ["h", "n"])

    found = scratch.stored(docs.select("text").mapInArrow(local, "h long, n long, total boolean").groupBy("h", "total").agg(F.sum("n").alias("n")))
    totals = found.filter("total").collect()
    total = sum(r.n for r in totals)
    often = (F.col("n") > 1) & (F.col("n") * rare > total)
    if all(r.h == 0 for r in totals):
        rows = found.filter(~F.col("total") & often).select("h", "n").toArrow()
        scratch.release(found)
        return *_sorted(rows), total
    chosen = found.filter((~F.col("total")) & (F.col("n") * 16 * rare >= total)).select("h").toArrow()
    keys = np.sort(np.asarray(chosen.column("h")).view(np.uint64))
    scratch.release(found)
    if not len(keys):
        return keys, np.zeros(0, np.int64), total
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    rows = docs.select("text").mapInArrow(exact, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(often).toArrow()
    return *_sorted(rows), total


def _sorted(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.asarray(rows.column("h")).view(np.uint64), np.asarray(rows.column("n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


def _merged(hashes: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([hashes, *more])
    n = np.concatenate([counts, np.ones(len(h) - len(hashes), np.int64)])
    order = np.argsort(h)
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(n, first) if len(first) else n


def weights(h: np.ndarray, tf: np.ndarray, known: tuple[np.ndarray, np.ndarray, int], rare: int = RARE) -> np.ndarray:
    keys, counts, total = known
    idf = np.full(len(h), np.log(1 + min(rare, max(1, total))))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        hit = keys[at] == h
        idf[hit] = np.log(1 + total / np.maximum(counts[at[hit]], total / rare))
    return idf * tf


def _draw(row: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order (unsigned, in the upper half) and t of the sample at a row of the table."""
    t = np.floor(np.log(weight) / _R[row] + _B[row])
    value = (np.log(_C[row]) - _R[row] * (t - _B[row]) - _R[row]).astype(np.float32).view(np.int32)
    order = np.where(value < 0, ~value, value ^ np.int32(-(1 << 31))).view(np.uint32)
    return order.astype(np.uint64) << np.uint64(32), t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)


class Sampler:
    """Band keys of texts, given the frequent shingles."""

    def __init__(self, known: tuple[np.ndarray, np.ndarray, int]):
        self.known = known
        self.flat = float(weights(np.zeros(1, np.uint64), np.ones(1), (np.zeros(0, np.uint64), None, known[2]))[0])
        self.drawn = np.bitwise_or(*_draw(np.arange(1 << TABLE), np.full(1 << TABLE, self.flat)))

    def bands(self, doc: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have shingles, and BANDS keys of each."""
        own, starts = np.unique(doc, return_index=True)
        other = np.flatnonzero(weight != self.flat)
        keys = np.zeros((len(own), BANDS), np.uint64)
        for k in range(BANDS * ROWS):
            turned = h * _TURN[k]
            row = (turned >> np.uint64(64 - TABLE)).view(np.int64)
            drawn = self.drawn[row]
            if len(other):
                drawn[other] = np.bitwise_or(*_draw(row[other], weight[other]))
            # ties of the order go by the product's lower half
            turned &= _LOW
            drawn ^= turned
            least = np.minimum.reduceat(drawn, starts)
            band = k // ROWS
            keys[:, band] = mix(keys[:, band] * np.uint64(0xC2B2AE3D27D4EB4F) + (least & _LOW) + np.uint64(k + 1))
        return own, keys


def sketches(docs: DataFrame, known) -> DataFrame:
    """uid, doc_id, digest, bands, size, hashes, weights of each row of (doc_id, text). Stored."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(shared.value)
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part, texts in pieces(batch, "text", 1 << 19):
                doc, h, tf = shingled(Words(texts))
                weight = weights(h, tf, shared.value)
                own, keys = sampler.bands(doc, h, weight)
                row_bands: list[list[int]] = [[] for _ in texts]
                for d, k in zip(own.tolist(), keys.view(np.int64).tolist(), strict=True):
                    row_bands[d] = k
                at = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
                top, light = (h >> np.uint64(32)).astype("<u4").tobytes(), weight.astype("<f4").tobytes()
                slices = list(zip(at[:-1], at[1:], strict=True))
                ids = np.arange(uid, uid + len(texts))
                uid += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), part.column(2), pa.array(row_bands, pa.list_(pa.int64())), pa.array([b - a for a, b in slices], pa.int32()), pa.array([top[4 * a : 4 * b] for a, b in slices], pa.binary()), pa.array([light[4 * a : 4 * b] for a, b in slices], pa.binary())], ["uid", "doc_id", "digest", "bands", "size", "hashes", "weights"])

    rows = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    schema = T.StructType([T.StructField("uid", T.LongType()), rows.schema["doc_id"], *T._parse_datatype_string("digest binary, bands array<long>, size int, hashes binary, weights binary").fields])
    return scratch.stored(rows.mapInArrow(work, schema))


def similarity(a: tuple[bytes, bytes], b: tuple[bytes, bytes]) -> float:
    """Weighted Jaccard similarity of two texts' sorted shingles and weights."""
    x, y = np.frombuffer(a[0], "<u4"), np.frombuffer(b[0], "<u4")
    v, w = np.frombuffer(a[1], "<f4"), np.frombuffer(b[1], "<f4")
    at = np.searchsorted(x, y)
    hit = np.flatnonzero(x[np.minimum(at, len(x) - 1)] == y) if len(x) else np.zeros(0, np.int64)
    common = float(np.minimum(v[at[hit]], w[hit]).sum(dtype=np.float64))
    total = float(v.sum(dtype=np.float64) + w.sum(dtype=np.float64)) - common
    return common / total if total else 0.0


def verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """(a, b) -> (a, b, similarity) of those pairs that are similar enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ha, wa, hb, wb = (c.to_pylist() for c in part.columns[2:])
                s = np.array([similarity((p, q), (r, t)) for p, q, r, t in zip(ha, wa, hb, wb, strict=True)])
                keep = np.flatnonzero(s >= least)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(s[keep])], ["a", "b", "similarity"])

    first = table.select(F.col("uid").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    second = table.select(F.col("uid").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(work, "a long, b long, similarity double")


def compared(group: pa.Table, least: float) -> pa.Table:
    """(bucket, uid, component, chunk, hashes, weights) of a group -> links (a, b) that join its components."""
    bucket, uid, component, chunk = (np.asarray(group.column(k)) for k in range(4))
    asked = apart(bucket, component, chunk)
    pairs: list[tuple[int, int]] = []
    if asked.any():
        hashes, weights_ = (group.column(k).to_pylist() for k in (4, 5))
        owner = np.repeat(np.arange(len(uid)), [len(x) // 4 for x in hashes])
        h, weight = np.frombuffer(b"".join(hashes), "<u4"), np.frombuffer(b"".join(weights_), "<f4").astype(np.float64)
        both = common(owner, h, weight, len(uid))
        own = np.bincount(owner, weight, len(uid))
        ratio = both / np.maximum(1e-9, own[:, None] + own[None, :] - both)
        similar = asked & (ratio >= least)
        for x, y in np.argwhere(asked & (np.abs(ratio - least) < 1e-4)).tolist():  # too near for single precision
            similar[x, y] = similarity((hashes[x], weights_[x]), (hashes[y], weights_[y])) >= least
        pairs = forest(similar, component)
    a, b = ([uid[p[k]] for p in pairs] for k in range(2))
    return pa.table({"a": pa.array(np.maximum(a, b) if pairs else [], pa.int64()), "b": pa.array(np.minimum(a, b) if pairs else [], pa.int64())})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A row for each row of ``docs``: uid, doc_id, digest, class_id (the least doc_id of the class), keep (true for one row of each class).

    Equal texts are one class, null and empty ones too; a text without words resembles no other. Of rows with equal doc_id and text, one
    is kept. Null ids come last. An empty table gives no rows."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    table = sketches(rows, frequent(rows))
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))
    firsts = scratch.stored(table.groupBy(F.col("digest").alias("of")).agg(F.min("uid").alias("first"), F.min_by(F.struct("bands", "size"), "uid").alias("own"), F.min(key).alias("head")))
    entries = firsts.select(F.posexplode("own.bands").alias("band", "bucket"), F.col("first").alias("uid"), F.col("own.size").alias("size"))
    members = shared(entries, firsts.count())
    small = scratch.stored(likely(table.select("uid", "hashes", "weights"), members, "uid"))
    ids = scratch.stored(table.select("uid", "doc_id", "digest"))
    scratch.release(table)  # the shingles of texts that resemble no other
    linked = classes(members, small, lambda pairs: verified(pairs, small, least), lambda group: compared(group, least), FIRST)
    named = scratch.stored(firsts.join(linked, F.col("first") == F.col("node"), "left").select("of", "head", F.coalesce("component", "first").alias("component")))
    heads = named.groupBy(F.col("component").alias("c")).agg(F.min("head").alias("stays"))
    of_text = scratch.stored(named.join(heads, F.col("component") == F.col("c")).select("of", "stays"))
    scratch.release(firsts, members, small, linked, named)
    return ids.join(of_text, F.col("digest") == F.col("of")).select("uid", "doc_id", "digest", F.col("stays.id").alias("class_id"), (F.col("uid") == F.col("stays.uid")).alias("keep"))


def kept(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with its columns. What goes is joined away by id and digest; of wholly repeated rows
    with one id and text one stays."""
    found = near_duplicates(docs, doc_id, text, least)
    per = scratch.stored(found.groupBy("doc_id", "digest").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("n")).filter("NOT keep OR n > 1").withColumnRenamed("doc_id", "own_id").withColumnRenamed("digest", "own_digest"))
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"), F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))).alias("hash"))
    same = F.col("own").eqNullSafe(F.col("own_id")) & (F.col("hash") == F.col("own_digest"))
    single = keyed.join(per, same, "left_anti")
    repeated = keyed.join(per.filter("keep"), same, "left_semi").dropDuplicates(["own", "hash"])
    return single.unionByName(repeated).select("row.*")
