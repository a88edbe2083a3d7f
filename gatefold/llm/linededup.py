"""Line dedup: banded min-wise samples of the words of normalised lines, edit similarity, one occurrence of each connected group.

A line is normalised to its words, lower-cased, digits as 0. Equal normalised lines are one, however many there are; the
rest works on distinct lines. Lines of edit similarity s over words share at least s / (2 - s) of their words, as multisets;
that is the chance with which a min-wise sample of one is that of the other, and BANDS keys of ROWS samples put such lines
into one bucket. ``graph.classes`` finds what similar lines in buckets connect. Of each connected group the first occurrence
stays, by doc_id, then line number.

SimHash blocks, which the method's name suggests, can't do this: two lines of similarity 0.9 differ in one bit of seven, so
a block of 32 bits is the same for one such pair in 150. The README has the figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import graph, scratch
from gatefold.llm.graph import WIDTH, apart, few_tasks, likely, marked, shared_of
from gatefold.llm.words import Words, as_bytes, mix

#: Similarity from which lines are one; bands, and samples of each: 0.935 of the pairs of similarity 0.9 share a band, 0.996 of those of 0.95.
SIMILARITY, BANDS, ROWS = 0.9, 6, 5
#: Bands that come first.
FIRST = 2
#: Columns of the bands' keys.
OF_BAND = [f"band{k}" for k in range(BANDS)]
#: Pairs of a group whose edits are counted at once, at first; members of a group of small buckets.
ASKED, PACK = 256, 256
#: Bytes of text that are worked on at a time, cells of the edit distances that are, the most cells of a pair that are held at once.
WINDOW, CELLS, HELD = 1 << 19, 1 << 18, 1 << 22
classes = partial(graph.classes, pack=PACK)
_DIGITS = bytes(48 if 48 <= b < 58 else b for b in range(256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.random.default_rng(23).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_words(least: float) -> int:
    """The fewest words of a line that may be similar, and not equal, to another: one edit is a share of 1 - least of the longer's."""
    return max(1, int(np.ceil(1 / (1 - least) - 1e-6)) - 1) if least < 1 else 1 << 30


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each word, sorted by text. A word's second occurrence in a text is another word, so that sets stand for multisets."""
    key = np.sort(w.text_of(np.arange(len(w))).astype(np.uint64) << np.uint64(40) | w.hashes >> np.uint64(24))
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    at = np.arange(len(key))
    again = at - np.maximum.accumulate(np.where(new, at, 0))
    return (key >> np.uint64(40)).astype(np.int64), mix((key & np.uint64((1 << 40) - 1)) + again.astype(np.uint64) * _PAIR)


def buckets(w: Words, lines: np.ndarray) -> np.ndarray:
    """BANDS keys for each of ``lines``, which have words."""
    text, token = tokens(w)
    mine = np.zeros(len(w.bounds) - 1, bool)
    mine[lines] = True
    token = token[mine[text]]
    n = np.diff(w.bounds)[lines]
    starts = np.cumsum(n) - n
    keys = np.zeros((len(lines), BANDS), np.uint64)
    for k in range(BANDS * ROWS) if len(lines) else ():
        turned = token * _TURN[k]
        turned ^= turned >> np.uint64(32)
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] * _PAIR + np.minimum.reduceat(turned, starts) + np.uint64(k + 1))
    return keys


def lines(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text, code) -> a row for each line that has words: uid, doc_id, code, line, key (two halves), size, words (32-bit hashes) and a column for each band (null for a line too short to resemble another). Stored."""
    shortest = least_words(least)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows, of, number, size = [], [], [], 0
            for d, t in enumerate([*as_bytes(batch.column(1)), None]):
                if t is not None:
                    own = t.translate(_DIGITS).split(b"\n")
                    rows += own
                    of += [d] * len(own)
                    number += range(len(own))
                    size += len(t)
                if rows and (t is None or size > WINDOW):
                    w = Words(rows)
                    n = np.diff(w.bounds)
                    keep = np.flatnonzero(n)
                    if len(keep):
                        long = keep[n[keep] >= shortest]
                        short, found = n[keep] < shortest, np.zeros((len(keep), BANDS), np.int64)
                        found[~short] = buckets(w, long).view(np.int64)
                        bands = [pa.array(np.ascontiguousarray(x), mask=short) for x in found.T]
                        lo, hi = w.bounds[keep], w.bounds[keep + 1]
                        inside = np.arange(len(w), dtype=np.uint64) - np.repeat(w.bounds[:-1], n).astype(np.uint64)
                        keys = []
                        for h in (mix(w.hashes), mix(w.hashes ^ _PAIR)):  # an ordered sum of word hashes: each is turned by its place in the line
                            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h + inside * _PAIR), dtype=np.uint64)))
                            keys.append(pa.array(mix(sums[hi] - sums[lo]).view(np.int64)))
                        blob = (w.hashes >> np.uint64(32)).astype("<u4").tobytes()
                        words = [blob[4 * a : 4 * b] if b - a >= shortest else b"" for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                        source = pa.array(np.array(of)[keep])
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + len(keep))), batch.column(0).take(source), batch.column(2).take(source), pa.array(np.array(number)[keep], pa.int32()), *keys, pa.array(n[keep], pa.int32()), pa.array(words, pa.binary()), *bands], ["uid", "doc_id", "code", "line", "key", "key2", "size", "words", *OF_BAND])
                        uid += len(keep)
                    rows, of, number, size = [], [], [], 0

    shape = T.StructType([T.StructField("uid", T.LongType()), docs.schema["doc_id"], *T._parse_datatype_string("code long, line int, key long, key2 long, size int, words binary").fields, *(T.StructField(c, T.LongType()) for c in OF_BAND)])
    return scratch.stored(docs.mapInArrow(work, shape), hashes=True)


def allowed(n: np.ndarray, least: float) -> np.ndarray:
    """Edits that leave lines similar of which the longer has n words."""
    return np.floor((1 - least) * n + 1e-6).astype(np.int64)


def edits(a: list[np.ndarray], b: list[np.ndarray], most: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of word sequences, or most + 1 where they are more; an edit inserts, removes or replaces one.

    Many pairs go through one table at once, of which only a band around the diagonal is held; the band starts narrow and
    doubles for those pairs that need it."""
    n, m = (np.array([len(x) for x in side], np.int64) for side in (a, b))
    out = most + 1
    band = 2
    open_ = np.flatnonzero(np.abs(n - m) <= most)
    while len(open_):
        left = []
        order = open_[np.argsort(n[open_], kind="stable")]
        cells, i = (n[order] + 1) * (2 * band + 1), 0
        while i < len(order):  # the lines are in order of their lengths, so the last one's is the greatest
            j = i + max(1, int(np.searchsorted(np.arange(1, len(order) - i + 1) * cells[i:], CELLS, "right")))
            own, i = order[i:j], j  # of pairs beyond HELD one at a time
            found = (_banded if cells[j - 1] <= HELD else _by_rows)([a[k] for k in own], [b[k] for k in own], n[own], m[own], band)
            sure = (found <= band) | (band >= most[own])
            out[own[sure]] = np.minimum(found[sure], most[own[sure]] + 1)
            left.append(own[~sure])
        open_, band = np.concatenate(left), 2 * band
    return out


def _banded(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray, band: int) -> np.ndarray:
    """Distances of up to ``band``, else more. For each number of edits and each diagonal (a word's place in b less that in a)
    only the farthest word of a is held that so many edits reach, so the steps are as many as edits, not as words."""
    pairs, high, far = len(a), int(n.max()) + 1, np.int64(1 << 40)
    x, y = np.full((pairs, high), -1, np.int64), np.full((pairs, high + 2 * band), -2, np.int64)
    x[np.arange(high) < n[:, None]] = np.concatenate(a)
    held = np.minimum(m, high + band)
    y[:, band:][np.arange(high + band) < held[:, None]] = np.concatenate([w[:k] for w, k in zip(b, held.tolist(), strict=True)])
    # where the words of a and b differ, diagonal by diagonal; they do from the end of either on
    differ = np.flatnonzero(np.stack([x != y[:, c : c + high] for c in range(2 * band + 1)]))
    diagonal = np.arange(-band, band + 1)[:, None]
    limit = np.minimum(n, m - diagonal)
    limit[limit < np.maximum(0, -diagonal)] = -far
    row = (np.arange(2 * band + 1)[:, None] * pairs + np.arange(pairs)) * high
    out = np.full(pairs, far, np.int64)
    ends, close = m - n + band, np.flatnonzero(np.abs(m - n) <= band)
    reach = np.full((2 * band + 3, pairs), -far)
    reach[band + 1] = 0
    for d in range(band + 1):
        near = slice(band - d, band + d + 1)
        if d:
            reach[band - d + 1 : band + d + 2] = np.maximum(np.maximum(reach[band - d + 1 : band + d + 2], reach[band - d + 2 : band + d + 3]) + 1, reach[band - d : band + d + 1])
        at = np.minimum(reach[band - d + 1 : band + d + 2], limit[near])
        from_ = row[near] + np.maximum(at, 0)
        reach[band - d + 1 : band + d + 2] = np.where(at >= 0, at + differ[np.searchsorted(differ, from_)] - from_, -far)
        done = close[(reach[ends[close] + 1, close] >= n[close]) & (out[close] == far)]
        out[done] = d
        if not (out[close] == far).any():
            break
    return out


def _by_rows(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, m: np.ndarray, band: int) -> np.ndarray:
    """As ``_banded``, for long lines: it holds a row of the band, not all. Cell c of row i stands for the first i words of a
    and i + c - band of b. ``n`` ascends."""
    pairs, width, far = len(a), 2 * band + 1, np.int32(1 << 29)
    high = int(n.max())
    x, y = np.zeros((pairs, high), np.uint32), np.zeros((pairs, high + width + 1), np.uint32)
    for k in range(pairs):
        x[k, : n[k]] = a[k]
        own = b[k][: high + band]
        y[k, band + 1 : band + 1 + len(own)] = own
    # a row holds each cell's distance less the cell's place, so that a running minimum along it is all that insertions take
    ramp = np.arange(width, dtype=np.int32)
    row = np.broadcast_to(np.where(ramp >= band, -band, far).astype(np.int32), (pairs, width)).copy()
    out = np.full(pairs, far, np.int64)
    ends = m - n + band  # the cell of the last row that holds the distance
    inside = (ends >= 0) & (ends < width)
    begin = np.searchsorted(n, np.arange(high + 2)).tolist()  # shorter lines of a come first, and are done first
    at = 0
    for i in range(high + 1):
        if i:
            if begin[i] > at:
                row, at = row[begin[i] - at :], begin[i]
            new = row + (y[at:, i : i + width] != x[at:, i - 1 : i])
            np.minimum(new[:, :-1], row[:, 1:] + 2, out=new[:, :-1])
            if i <= band:  # cells left of b's beginning, and its beginning
                new[:, : band - i] = far
                new[:, band - i] = 2 * i - band
            row = np.minimum.accumulate(new, axis=1)
        if begin[i + 1] > begin[i]:
            last = np.arange(begin[i], begin[i + 1])
            last = last[inside[last]]
            out[last] = row[last - at, ends[last]] + ends[last]
    return out


def counted(owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and word, sorted by both; a word's k-th occurrence has k in the bits above its own 32."""
    key = np.sort(owner.astype(np.uint64) << np.uint64(32) | word)
    new = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    at = np.arange(len(key))
    again = at - np.maximum.accumulate(np.where(new, at, 0))
    return (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF) | again.astype(np.uint64) << np.uint64(32)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """For each pair the words that both have; an edit takes one of the longer's away at most."""
    sides = []
    for side in (a, b):
        owner, word = counted(np.repeat(np.arange(len(side)), [len(x) for x in side]), np.concatenate(side) if side else np.zeros(0, np.uint32))
        sides.append(mix(word) ^ mix(owner.astype(np.uint64) + np.uint64(1)) * _PAIR)
    _, at, _ = np.intersect1d(*sides, return_indices=True)
    owner = counted(np.repeat(np.arange(len(a)), [len(x) for x in a]), np.concatenate(a) if a else np.zeros(0, np.uint32))[0]
    return np.bincount(owner[at], minlength=len(a))


def both_hold(words: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What ``overlaps`` says of pairs x, y of ``words``; each is held once, as bits, however many pairs it is of."""
    out = np.zeros(len(x), np.int64)
    if not len(x):
        return out
    owner, word = counted(np.repeat(np.arange(len(words)), [len(w) for w in words]), np.concatenate(words))
    column, n = np.unique(word, return_inverse=True, return_counts=True)[1:]
    more = n > 1  # what one line alone holds is not common
    owner, column = owner[more[column]], (np.cumsum(more) - 1)[column[more[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(more.sum()), WIDTH):
        a, b = np.searchsorted(column, (low, low + WIDTH))
        bits = np.zeros((len(words), WIDTH), bool)
        bits[owner[a:b], column[a:b] - low] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(0, len(x), WIDTH):
            out[i : i + WIDTH] += np.bitwise_count(bits[x[i : i + WIDTH]] & bits[y[i : i + WIDTH]]).sum(1, dtype=np.int64)
    return out


def verified(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """(a, b) -> (a, b) of lines whose edit similarity is large enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                a, b = ([np.frombuffer(x, "<u4") for x in c.to_pylist()] for c in part.columns[2:])
                longer = np.maximum(*(np.array([len(x) for x in side]) for side in (a, b)))
                most = allowed(longer, least)
                likely = np.flatnonzero(overlaps(a, b) >= longer - most)
                near = edits([a[k] for k in likely], [b[k] for k in likely], most[likely]) <= most[likely]
                keep = pa.array(likely[near])
                yield pa.RecordBatch.from_arrays([part.column(0).take(keep), part.column(1).take(keep)], ["a", "b"])

    first = table.select(F.col("uid").alias("a"), F.col("words").alias("wa"))
    second = table.select(F.col("uid").alias("b"), F.col("words").alias("wb"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "wa", "wb").mapInArrow(work, "a long, b long")


def compared(group: pa.Table, least: float) -> pa.Table:
    """(bucket, uid, component, chunk, words) of a group -> links (a, b) that join its components."""
    bucket, uid, component, chunk = (np.asarray(group.column(k)) for k in range(4))
    pairs: list[tuple[int, int]] = []
    words = [np.frombuffer(x, "<u4") for x in group.column(4).to_pylist()]
    size = np.array([len(x) for x in words], np.int64)
    x, y = np.nonzero(np.triu(apart(bucket, component, chunk)))
    longer = np.maximum(size[x], size[y])
    most = allowed(longer, least)
    ask = np.abs(size[x] - size[y]) <= most
    x, y, longer, most = x[ask], y[ask], longer[ask], most[ask]
    ask = both_hold(words, x, y) >= longer - most
    x, y, most = x[ask], y[ask], most[ask]
    first, of = np.unique(bucket, return_index=True, return_inverse=True)[1:]
    star = x == first[of[x]]  # pairs with a bucket's first member come first: they join most of it
    order = np.argsort(~star, kind="stable")
    x, y, most = x[order], y[order], most[order]
    label = np.unique(component, return_inverse=True)[1]
    step = max(ASKED, int(star.sum()))
    while len(x):  # what a batch joins need not be asked again
        now, bound, x, y, most = (x[:step], y[:step]), most[:step], x[step:], y[step:], most[step:]
        step = min(2 * step, 4 * ASKED)
        near = edits([words[k] for k in now[0]], [words[k] for k in now[1]], bound) <= bound
        for p, q in zip(now[0][near].tolist(), now[1][near].tolist(), strict=True):
            if label[p] != label[q]:
                label[label == label[q]] = label[p]
                pairs.append((p, q))
        ask = label[x] != label[y]
        x, y, most = x[ask], y[ask], most[ask]
    a, b = ([uid[p[k]] for p in pairs] for k in range(2))
    return pa.table({"a": pa.array(np.maximum(a, b) if pairs else [], pa.int64()), "b": pa.array(np.minimum(a, b) if pairs else [], pa.int64())})


def removals(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text, code) -> own_id, own_code, gone: the numbers of the lines that go, of each document that has some. Stored.

    An empty table, or one without repeated lines, gives no rows; null ids come last, so that other occurrences stay first."""
    table = lines(docs, least)
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("code").alias("code"), F.col("line").alias("line"))
    rows = table.count()
    # one of equal lines stands for all; no aggregate of these holds more than numbers, so none sorts the lines
    equal = scratch.stored(few_tasks(table.groupBy("key", "key2").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("n")).filter("n > 1"), rows))
    long = marked(table.filter(F.col(OF_BAND[0]).isNotNull()).select("uid", "key", "key2", "size", *OF_BAND), equal, "key", "key2")
    stands = equal.select(F.col("key").alias("k"), F.col("key2").alias("k2"), F.col("uid").alias("first"))
    some = long.filter("maybe").join(stands, (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")), "left").filter("first IS NULL OR first = uid")
    distinct = scratch.stored(few_tasks(long.filter("NOT maybe").select("uid", "size", *OF_BAND).union(some.select("uid", "size", *OF_BAND)), rows), hashes=True)
    members = shared_of(distinct, OF_BAND, rows)
    words = scratch.stored(likely(table.select("uid", "words"), members, "uid"), hashes=True)
    scratch.release(distinct)
    linked = classes(members, words, lambda pairs: verified(pairs, words, least), lambda group: compared(group, least), FIRST)
    scratch.release(members, words)
    named = equal.select("key", "key2", "uid").join(linked, F.col("uid") == F.col("node"), "full")
    named = scratch.stored(few_tasks(named.select("key", "key2", F.coalesce("uid", "node").alias("first"), F.coalesce("component", "uid").alias("component")), rows))
    alone = named.filter("key IS NULL").select("first", "component")  # no other line is equal
    copied = named.filter("key IS NOT NULL").select(F.col("key").alias("k"), F.col("key2").alias("k2"), "component")
    copies = likely(table.select("doc_id", "code", "line", "key", "key2"), equal, "key", "key2").join(copied, (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")))
    others = likely(table.select("uid", "doc_id", "code", "line"), alone.withColumnRenamed("first", "uid"), "uid").join(alone, F.col("uid") == F.col("first"))
    grouped = scratch.stored(few_tasks(copies.select("component", "doc_id", "code", "line").union(others.select("component", "doc_id", "code", "line")), rows))
    heads = scratch.stored(few_tasks(grouped.groupBy(F.col("component").alias("c")).agg(F.min(place).alias("stays")), rows))
    gone = grouped.join(heads, F.col("component") == F.col("c")).filter(~place.eqNullSafe(F.col("stays")))
    out = scratch.stored(gone.groupBy(F.col("doc_id").alias("own_id"), F.col("code").alias("own_code")).agg(F.collect_set("line").alias("gone")))
    scratch.release(table, equal, linked, named, grouped, heads)
    return out


def _lines(text: Column) -> Column:
    """Line feeds and one more; null has none."""
    return F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")


def deduped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """row (the document's own columns, with the text that stays), n_lines, n_removed.

    Lines end at line feeds; a line without words, a blank one too, always stays. Null texts stay null and have no lines.
    Rows with equal doc_id and text are one document and give equal rows; so are rows with equal texts and null ids, which
    come after all others. Of ties the one with the lesser hash of its text is first. An empty table gives no rows."""
    docs = docs.withColumn(text, F.col(text).cast("string"))
    code = F.xxhash64(text)
    gone = removals(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), code.alias("code")), least)
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(doc_id).alias("own"), code.alias("of"))
    # only texts of which lines may go are shuffled, by the same plan at any size
    keyed = marked(keyed, gone.select(F.col("own_id").alias("own"), F.col("own_code").alias("of")), "own", "of")
    joined = keyed.filter("maybe").join(gone.hint("merge"), F.col("own").eqNullSafe(F.col("own_id")) & (F.col("of") == F.col("own_code")), "left").select("row", "gone")
    whole = keyed.filter("NOT maybe").select("row", _lines(F.col("row")[text]).alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    place = docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fields = part.column(0).flatten()
                out, count, less = [], [], []
                for t, g in zip(fields[place].to_pylist(), part.column(1).to_pylist(), strict=True):
                    count.append(t.count("\n") + 1 if t is not None else 0)
                    less.append(len(g or ()))
                    if g:
                        drop = set(g)
                        t = "\n".join([x for k, x in enumerate(t.split("\n")) if k not in drop])
                    out.append(t)
                fields[place] = pa.array(out, pa.string())
                row = pa.StructArray.from_arrays(fields, fields=list(part.column(0).type))
                yield pa.RecordBatch.from_arrays([row, pa.array(count, pa.int64()), pa.array(less, pa.int64())], ["row", "n_lines", "n_removed"])

    return joined.mapInArrow(cut, T.StructType([joined.schema["row"], *T._parse_datatype_string("n_lines long, n_removed long").fields])).unionByName(whole)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents without repeated lines, with their columns; one from which all words went is dropped. ``length``, if
    there is such a column, becomes the new text's. Nulls, ties and empty tables are as for ``deduped``."""
    found = deduped(docs, doc_id, text)
    own = {c: F.col(f"row.`{c}`") for c in docs.columns}
    stays = found.filter((F.col("n_removed") == 0) | own[text].rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    if length in own:
        own[length] = F.when(F.col("n_removed") > 0, F.length(own[text])).otherwise(own[length])
    return stays.select(*[own[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
