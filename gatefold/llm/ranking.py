"""Ranked lexical search: a compressed inverted index, searched by Block-Max MaxScore.

Documents are indexed in segments of about SEGMENT bytes of text, each made within one task, so that building needs no
shuffle. In a segment documents stand in the order of their ids, and a term's postings (gap, frequency) are packed in
blocks of BLOCK with the block's last document and its largest part of a score. A search reads the lists of the queries'
terms only. For each query the lists' own maxima split them: those that together can't reach the k-th best score so far
are non-essential. Candidates come from the essential lists; on the others block maxima reject candidates before a block
is unpacked. A task goes through many segments with one heap for each query; the heaps of all tasks are merged.

Terms of a segment are told apart by 64-bit hashes and stored in full; lists of different segments meet by the full term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch
from gatefold.llm.words import Words, pieces

#: Bytes of text of a segment (one longer text is a segment too), postings of a block, (query, term) pairs searched at a time.
SEGMENT, BLOCK, MOST_PAIRS = 8 << 20, 64, 400_000
#: Documents of a search's first window; each next one is twice as long.
FIRST = 256

_HEAD = np.dtype([("last", "<i4"), ("gap", "u1"), ("tf", "u1"), ("pad", "<u2"), ("most", "<i8")])


def _width(x: np.ndarray) -> np.ndarray:
    return np.where(x < 1 << 8, 1, np.where(x < 1 << 16, 2, 4)).astype(np.int64)


def _put(out: np.ndarray, at: np.ndarray, x: np.ndarray, width: np.ndarray) -> None:
    """Writes little-endian numbers of 1, 2 or 4 bytes."""
    for k in range(4):
        some = width > k
        out[at[some] + k] = (x[some] >> (8 * k)) & 255


def _cuts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


def _binaries(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def part_of_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def segment(texts: list[bytes], m: np.ndarray, w: Words) -> dict[str, pa.Array]:
    """The lists of one segment's terms: term, df, most, heads, posts. ``m`` by text."""
    docs = len(texts)
    _, first, term = np.unique(w.hashes, return_index=True, return_inverse=True)
    key, tf = np.unique(term * docs + np.repeat(np.arange(docs), np.diff(w.bounds)), return_counts=True)
    term, doc = key // docs, key % docs
    df = np.bincount(term, minlength=len(first))
    starts = _cuts(df)
    part = part_of_score(tf, m[doc])
    blocks_of = -(-df // BLOCK)
    block_cuts = _cuts(blocks_of)
    block_term = np.repeat(np.arange(len(df)), blocks_of)
    begin = starts[block_term] + BLOCK * (np.arange(len(block_term)) - block_cuts[block_term])
    size = np.minimum(begin + BLOCK, starts[block_term + 1]) - begin
    block = np.repeat(np.arange(len(begin)), size)
    before = np.concatenate(([-1], doc[:-1]))
    before[starts[:-1]] = -1
    gap = doc - before - 1
    gap_width, tf_width = _width(np.maximum.reduceat(gap, begin)), _width(np.maximum.reduceat(tf, begin))
    at = _cuts(size * (gap_width + tf_width))
    within = np.arange(len(doc)) - begin[block]
    data = np.zeros(at[-1], np.uint8)
    _put(data, at[block] + within * gap_width[block], gap, gap_width[block])
    _put(data, at[block] + size[block] * gap_width[block] + within * tf_width[block], tf, tf_width[block])
    heads = np.zeros(len(begin), _HEAD)
    heads["last"], heads["gap"], heads["tf"], heads["most"] = doc[begin + size - 1], gap_width, tf_width, np.maximum.reduceat(part, begin)
    low = w.low
    terms = pa.array([low[a:b].tobytes() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
    return {"term": terms, "df": pa.array(df, pa.int64()), "most": pa.array(np.maximum.reduceat(heads["most"], block_cuts[:-1]), pa.int64()), "heads": _binaries(heads.view(np.uint8), block_cuts * _HEAD.itemsize), "posts": _binaries(data, at[block_cuts])}


class Postings:
    """One term's list in one segment; blocks are unpacked when they are asked for."""

    def __init__(self, df: int, most: int, heads: bytes, posts: bytes, m: np.ndarray):
        self.most, self.posts, self.m, self.df = most, posts, m, df
        h = np.frombuffer(heads, _HEAD)
        self.last, self.block_most = h["last"].astype(np.int64), h["most"]
        self.gap, self.tf = h["gap"].astype(np.int64), h["tf"].astype(np.int64)
        self.size = np.minimum(BLOCK, df - BLOCK * np.arange(len(h)))
        self.at = _cuts(self.size * (self.gap + self.tf))
        self.done = np.zeros(len(h), bool)
        self.docs, self.parts = np.zeros(df, np.int64), np.zeros(df, np.int64)

    def unpack(self, blocks: np.ndarray) -> None:
        for b in blocks[~self.done[blocks]].tolist():
            n, at, wide = int(self.size[b]), int(self.at[b]), int(self.gap[b])
            gap = np.frombuffer(self.posts, f"<u{wide}", n, at).astype(np.int64)
            tf = np.frombuffer(self.posts, f"<u{int(self.tf[b])}", n, at + n * wide).astype(np.int64)
            docs = np.cumsum(gap + 1) + (int(self.last[b - 1]) if b else -1)
            own = slice(b * BLOCK, b * BLOCK + n)
            self.docs[own], self.parts[own] = docs, part_of_score(tf, self.m[docs])
            self.done[b] = True

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from a to below b, and their parts of a score."""
        lo, hi = np.searchsorted(self.last, (a, b - 1)).tolist()
        hi = min(hi + 1, len(self.last))
        self.unpack(np.arange(lo, hi))
        i, j = (np.searchsorted(self.docs[lo * BLOCK : hi * BLOCK], (a, b)) + lo * BLOCK).tolist()
        return self.docs[i:j], self.parts[i:j]


def best(lists: list[tuple[int, Postings]], docs: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents of a segment and their scores: all of its k best (highest first, then lowest document) that reach ``floor``
    and are above 0. lists: weight and postings of each term of the query."""
    lists = sorted(((w, x) for w, x in lists if w > 0), key=lambda y: y[0] * y[1].most)
    reach = np.cumsum([0, *(w * x.most for w, x in lists)])
    top_doc, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, step, floor = 0, FIRST, max(floor, 1)
    while a < docs:
        b = min(docs, a + step)
        # lists[:e] can't reach the floor together
        e = int(np.searchsorted(reach, floor, "left")) - 1
        if e >= len(lists):
            break
        score = np.zeros(b - a, np.int64)
        for w, x in lists[e:]:
            own, part = x.between(a, b)
            score[own - a] += w * part
        cand = np.flatnonzero(score)
        for i in range(e - 1, -1, -1):
            w, x = lists[i]
            cand = cand[score[cand] + reach[i + 1] >= floor]
            if not len(cand):
                break
            block = np.searchsorted(x.last, cand + a)
            inside = block < len(x.last)
            block[~inside] = 0
            fits = score[cand] + reach[i] + np.where(inside, w * x.block_most[block], 0) >= floor
            cand, block, inside = cand[fits], block[fits], inside[fits]
            if inside.any():
                x.unpack(np.unique(block[inside]))
                want = cand[inside] + a
                full = x.docs if x.done.all() else np.where(np.repeat(x.done, x.size), x.docs, np.repeat(x.last, x.size))
                at = np.minimum(np.searchsorted(full, want), x.df - 1)
                same = (x.docs[at] == want) & x.done[at // BLOCK]
                score[want[same] - a] += w * x.parts[at[same]]
        cand = cand[score[cand] >= floor]
        if len(cand):
            top_doc, top = np.concatenate((top_doc, cand + a)), np.concatenate((top, score[cand]))
            order = np.lexsort((top_doc, -top))[:k]
            top_doc, top = top_doc[order], top[order]
            if len(top) == k:
                floor = max(floor, int(top[-1]))
        a, step = b, step * 2
    return top_doc, top


@dataclass
class Index:
    """table: a row for each term of each segment, and one for the segment itself with its documents' ids and m."""

    table: DataFrame
    documents: int
    words: int


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, written to the shared folder. Null and empty texts have no terms and count nowhere;
    repeated rows are documents of their own; a null id is one like others. Other columns aren't read."""
    scratch.lean(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in batches:
            for _, texts in pieces(batch, "text"):
                own = np.diff(Words(texts, hashed=False).bounds)
                n, words = n + int((own > 0).sum()), words + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], ["n", "words"])

    total = rows.select("text").mapInArrow(count, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    n_docs, n_words = int(total[0]), int(total[1])
    key = rows.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("segment", T.LongType()), T.StructField("term", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("df", "most")), *(T.StructField(c, T.BinaryType()) for c in ("heads", "posts", "m")), T.StructField("ids", T.ArrayType(key))])

    def make(held: list[tuple[pa.Array, list[bytes]]], number: int) -> Iterator[pa.RecordBatch]:
        ids, texts = pa.concat_arrays([i for i, _ in held]), [t for _, own in held for t in own]
        some = np.flatnonzero(np.diff(Words(texts, hashed=False).bounds))
        if not len(some):
            return
        order = some[np.asarray(pc.sort_indices(ids.take(pa.array(some)), null_placement="at_end"))]
        ids, texts = ids.take(pa.array(order)), [texts[i] for i in order]
        w = Words(texts)
        m = np.array([10 + 90 * int(x) * n_docs // n_words for x in np.diff(w.bounds)], np.int64)
        cols = segment(texts, m, w)
        rows = len(cols["term"])
        lists = pa.array([ids], pa.list_(ids.type))
        head = {"segment": pa.array([number], pa.int64()), "m": pa.array([m.tobytes()], pa.binary()), "ids": lists}
        own = {"segment": pa.array(np.full(rows, number, np.int64))} | cols
        for part, n in ((head, 1), (own, rows)):
            yield pa.RecordBatch.from_arrays([part[f.name] if f.name in part else pa.nulls(n, t) for f, t in zip(shape, kinds(ids.type), strict=True)], shape.names)

    def kinds(key: pa.DataType) -> list[pa.DataType]:
        return [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(key)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                held.append((part.column(0), texts))
                size += sum(map(len, texts))
                if size >= SEGMENT:
                    yield from make(held, number)
                    number, held, size = number + 1, [], 0
        if held:
            yield from make(held, number)

    return Index(scratch.stored(rows.mapInArrow(index, shape)), n_docs, n_words)


def _terms(queries: DataFrame) -> DataFrame:
    """item and term, once each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                w = Words(texts, hashed=False)
                joined, at = w.compact()
                pairs = dict.fromkeys((d, joined[at[i] : at[i + 1] - 1]) for d in range(len(texts)) for i in range(w.bounds[d], w.bounds[d + 1]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([d for d, _ in pairs], pa.int64())), pa.array([t for _, t in pairs], pa.binary()).cast(pa.string())], ["item", "term"])

    return queries.mapInArrow(cut, T.StructType([queries.schema["item"], T.StructField("term", T.StringType())])).distinct()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(index: Index, queries: DataFrame, k: int = 10, item_id: str = "item_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each query, scores above 0, equal ones by ascending id (null last).

    Rows of queries with one id are one query of all their terms; those with a null id, or without terms, have no results.
    Queries are broadcast in blocks of about ``most_pairs`` (query, term) pairs; each block is a pass over its terms' lists."""
    pairs = _terms(queries.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item"), F.col(text).cast("string").alias("text")))
    shape = T.StructType([pairs.schema["item"], T.StructField("doc_id", index.table.schema["ids"].dataType.elementType), T.StructField("score", T.LongType())])
    blocks = max(1, -(-pairs.count() // most_pairs))
    parts = []
    for n in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n)
        table = own.toArrow()
        terms = own.select("term").distinct()
        df = {r.term: r.df for r in index.table.select("term", "df").join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weights = {t: weight(index.documents, x) for t, x in df.items()}
        by_item: dict = {}
        for item, term in zip(table.column("item").to_pylist(), table.column("term").to_pylist(), strict=True):
            by_item.setdefault(item, []).append(term)
        plan = [(item, [t for t in sorted(own) if weights.get(t, 0) > 0]) for item, own in sorted(by_item.items())]
        plan = [x for x in plan if x[1]]
        shared = index.table.sparkSession.sparkContext.broadcast((plan, weights, table.schema.field("item").type))
        wanted = index.table.join(F.broadcast(terms.withColumn("wanted", F.lit(True))), "term", "left").filter("wanted OR ids IS NOT NULL")
        # equal ids of segments never meet others' rows; a segment's own row, whose term is null, stands first
        dealt = wanted.select("segment", "term", "df", "most", "heads", "posts", "m", "ids").repartition("segment").sortWithinPartitions("segment", "term")
        parts.append(dealt.mapInArrow(lambda batches, shared=shared: _search(batches, shared, k), shape))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("item").alias("item_id"), "rank", "doc_id", "score")


def _search(batches: Iterator[pa.RecordBatch], shared, k: int) -> Iterator[pa.RecordBatch]:
    plan, weights, kind = shared.value
    heaps: list[list[tuple]] = [[] for _ in plan]
    now, ids, m, lists, ids_type = None, None, None, {}, None

    def over() -> None:
        for heap, (_, terms) in zip(heaps, plan, strict=True):
            own = [(weights[t], lists[t]) for t in terms if t in lists]
            if not own:
                continue
            docs, scores = best(own, len(m), k, heap[-1][0] if len(heap) == k else 0)
            if len(docs):
                heap += [(s, x) for s, x in zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist(), strict=True)]
                heap.sort(key=lambda y: (y[1] is None, y[1] if y[1] is not None else 0))
                heap.sort(key=lambda y: -y[0])
                del heap[k:]

    for batch in batches:
        col = {f: batch.column(j) for j, f in enumerate(batch.schema.names)}
        ids_type = col["ids"].type.value_type
        number, term, df, most = (col[c].to_pylist() for c in ("segment", "term", "df", "most"))
        for i, s in enumerate(number):
            if s != now:
                if now is not None:
                    over()
                now, lists = s, {}
                ids, m = col["ids"][i].values, np.frombuffer(col["m"][i].as_py(), np.int64)
            else:
                lists[term[i]] = Postings(df[i], most[i], col["heads"][i].as_py(), col["posts"][i].as_py(), m)
    if now is not None:
        over()
        rows = [(item, x, s) for heap, (item, _) in zip(heaps, plan, strict=True) for s, x in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], ids_type), pa.array([r[2] for r in rows], pa.int64())], ["item", "doc_id", "score"])


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, **names: str) -> DataFrame:
    """``search`` over a new index of ``docs``."""
    return search(build(docs, **names), queries, k)
