"""Benchmark decontamination: an exact containment join of item windows with documents, by prefix filtering.

Items are cut into windows of ``window`` consecutive words (a shorter item is one window). A document contains a window
if it contains every shingle of it, so one shingle of each window, the rarest of all documents, is the necessary prefix.
Documents are probed with those alone; a hit is kept if the window fits between the document's bounds at the shingle's
place (length and position), and is then compared word by word.

Windows are broadcast in blocks of at most ``block_pairs`` (window, item) pairs. One block holds any usual benchmark; more
blocks mean more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm.words import Words, pieces

#: Words of a window, words of a shingle, (window, item) pairs of a block.
WINDOW, SHINGLE, BLOCK_PAIRS = 10, 5, 400_000

_WINDOWS = "item string, words binary, n int"
_BITS = np.uint64(20)


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """A row for each distinct window of each item: item, words (each followed by a blank), n."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                w = Words(texts, hashed=False)
                joined, at = w.compact()
                ids = part.column(0).to_pylist()
                out: dict[tuple, None] = {}
                for d, name in enumerate(ids):
                    lo, hi = w.bounds[d], w.bounds[d + 1]
                    for i in range(lo, max(hi - window, lo) + 1 if hi > lo else lo):
                        j = min(i + window, hi)
                        out[name, joined[at[i] : at[j]], int(j - i)] = None
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.binary(), pa.int32()), strict=True)], ["item", "words", "n"])

    named = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return named.filter("item IS NOT NULL").mapInArrow(cut, _WINDOWS).distinct()


class _Block:
    """Windows of one block, their items and the shingles each could be found by."""

    def __init__(self, table: pa.Table, shingle: int):
        words, n, item = (table.column(c).to_pylist() for c in ("words", "n", "item"))
        self.items: dict[bytes, list[str]] = {}
        lengths = {}
        for w, k, i in zip(words, n, item, strict=True):
            self.items.setdefault(w, []).append(i)
            lengths[w] = k
        self.windows = list(self.items)
        self.n = np.array([lengths[w] for w in self.windows], np.int64)
        table_of = Words(self.windows)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {min(shingle, int(x)) for x in self.n}:
            hashes, inside = table_of.shingles(k)
            at = np.flatnonzero(inside)
            of = table_of.text_of(at)
            mine = np.minimum(shingle, self.n[of]) == k
            at, of = at[mine], of[mine]
            self.by_size[k] = hashes[at], of, at - table_of.bounds[of]

    def prefixes(self, seen: dict[tuple[int, int], int]) -> None:
        """Keeps of each window the shingle that the fewest documents hold."""
        self.index = {}
        for k, (hashes, of, off) in self.by_size.items():
            counts = np.array([seen.get((k, int(h) - (1 << 63)), 0) for h in hashes], np.int64)
            order = np.lexsort((off, hashes, counts, of))
            first = order[np.unique(of[order], return_index=True)[1]]
            rank = first[np.argsort(hashes[first], kind="stable")]
            self.index[k] = _filter(hashes[rank]), hashes[rank], of[rank], off[rank]
        del self.by_size


def _filter(hashes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << int(_BITS), bool)
    bits[(hashes >> (np.uint64(64) - _BITS)).astype(np.int64)] = True
    return bits


def _among(hashes: np.ndarray, inside: np.ndarray, bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the shingles that are among the sorted keys."""
    at = np.flatnonzero(bits[(hashes >> (np.uint64(64) - _BITS)).astype(np.int64)] & inside)
    near = np.searchsorted(keys, hashes[at])
    return at[keys[np.minimum(near, len(keys) - 1)] == hashes[at]]


def _document_counts(texts: DataFrame, block) -> dict[tuple[int, int], int]:
    """For each shingle of the block's windows, the documents that hold it; as many rows as the block has shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = {k: np.unique(h) for k, (h, _, _) in block.value.by_size.items()}
        bits = {k: _filter(h) for k, h in keys.items()}
        total = {k: np.zeros(len(h), np.int64) for k, h in keys.items()}
        for batch in batches:
            for _, rows in pieces(batch, "text"):
                w = Words(rows)
                for k, own in keys.items():
                    h, inside = w.shingles(k)
                    at = _among(h, inside, bits[k], own)
                    pair = np.unique(w.text_of(at) * len(own) + np.searchsorted(own, h[at]))
                    total[k] += np.bincount(pair % len(own), minlength=len(own))
        for k, own in keys.items():
            some = total[k] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), k, np.int32)), pa.array((own[some] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(total[k][some])], ["k", "h", "n"])

    rows = texts.select("text").mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))
    return {(r.k, r.h): r.n for r in rows.collect()}


def _probe(block, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = block.value
    hashes_of = Words(b.windows)
    wanted = hashes_of.hashes  # by window, its words' hashes
    first = hashes_of.bounds
    for batch in batches:
        for part, rows in pieces(batch, "text"):
            w = Words(rows)
            starts, wins = [], []
            for k, (bits, keys, of, off) in b.index.items():
                h, inside = w.shingles(k)
                at = _among(h, inside, bits, keys)
                if not len(at):
                    continue
                lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
                each = hi - lo
                post = np.repeat(lo - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
                text = np.repeat(w.text_of(at), each)
                start, win = np.repeat(at, each) - off[post], of[post]
                fits = (start >= w.bounds[text]) & (start + b.n[win] <= w.bounds[text + 1])
                start, win = start[fits], win[fits]
                for j in range(int(b.n.max())):  # cheap before exact
                    inner = j < b.n[win]
                    same = ~inner
                    same[inner] = w.hashes[start[inner] + j] == wanted[first[win[inner]] + j]
                    start, win = start[same], win[same]
                starts.append(start)
                wins.append(win)
            spans, items = [[] for _ in rows], [[] for _ in rows]
            if starts and (start := np.concatenate(starts)).size:
                win = np.concatenate(wins)
                joined, at = w.compact()
                text = w.text_of(start)
                order = np.lexsort((start, text))
                found: dict[int, set[str]] = {}
                for i, x, d in zip(start[order].tolist(), win[order].tolist(), text[order].tolist(), strict=True):
                    n = int(b.n[x])
                    if joined[at[i] : at[i + n]] != b.windows[x]:
                        continue
                    found.setdefault(d, set()).update(b.items[b.windows[x]])
                    i -= int(w.bounds[d])
                    if spans[d] and i <= spans[d][-1][1]:
                        spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], i + n))
                    else:
                        spans[d].append((i, i + n))
                for d, names in found.items():
                    items[d] = sorted(names)
            old = part.column(part.schema.get_field_index("found")).to_pylist()
            out = []
            for x, own, names in zip(old, spans, items, strict=True):
                merged = []
                for s, e in sorted(own + [(y["start"], y["end"]) for y in x["spans"]]) if x["spans"] else own:
                    if merged and s <= merged[-1][1]:
                        merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
                    else:
                        merged.append((s, e))
                out.append({"spans": [{"start": s, "end": e} for s, e in merged], "items": x["items"] + names})
            n_words = np.diff(w.bounds)
            for d, x in enumerate(out):
                x["n_words"] = int(n_words[d])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, part.schema.field("found").type)], part.schema.names)


def annotate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``row`` (a struct of the document's own columns, whatever their names) and ``found``: n_words, spans (word ranges
    that windows cover, merged), items (ids as strings, sorted as strings).

    Null and empty texts have no words and no spans. Items without words or without an id are no items. Equal items are
    all listed. Repeated documents give equal rows. Empty tables give empty results or empty spans."""
    struct = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("items", T.ArrayType(T.StringType()))])
    windows = item_windows(items, item_id, item_text, window)
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("text"), F.lit(None).cast("string").alias("pad"))
    out = out.select("row", "text", F.struct(F.lit(0).cast("long").alias("n_words"), F.expr("array_repeat(named_struct('start', 0L, 'end', 0L), 0)").alias("spans"), F.expr("array_repeat('', 0)").alias("items")).alias("found"))
    shape = T.StructType([out.schema["row"], T.StructField("text", T.StringType()), T.StructField("found", struct)])
    blocks = max(1, -(-windows.count() // block_pairs))
    for k in range(blocks):
        table = windows.filter(F.pmod(F.xxhash64("words", "item"), F.lit(blocks)) == k).toArrow()
        block = _Block(table, shingle)
        if not block.windows and k:
            continue
        context = docs.sparkSession.sparkContext
        shared = context.broadcast(block)
        block.prefixes(_document_counts(out, shared))
        shared.unpersist()
        shared = context.broadcast(block)
        out = out.mapInArrow(lambda batches, own=shared: _probe(own, batches), shape)
    found = F.col("found")
    return out.select("row", F.struct(found["n_words"].alias("n_words"), found["spans"].alias("spans"), F.array_sort(F.array_distinct(found["items"])).alias("items")).alias("found"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their columns."""
    return annotate(docs, items, text, **options).filter(F.size("found.spans") == 0).select("row.*")


def report(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of each document."""
    found = annotate(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, **options)
    n_hit = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("row.doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"), F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.size("found.spans") > 0).alias("contaminated"), "found.spans")
