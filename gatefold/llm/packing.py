"""Packing token pieces into sequences of fixed length by a linear grouping scheme.

Only the counts of each length (at most ``capacity`` numbers) reach the driver, which plans there:

1. Lengths above a share of the capacity are large. In descending order they are cut into groups of equal cardinality
   and rounded up to the largest of their group, so few sizes are left.
2. Configurations of those sizes (multisets that fit one sequence) are optimised by column generation: a linear
   programme over configurations, priced by a knapsack over the sizes, rounded down.
3. Actual lengths are substituted for the sizes; they are no longer, so all fits. What rounding left over goes in by best fit.
4. Small lengths fill the real space that is left, largest first, by best fit.

A plan is a list of runs: of the pieces of one length, those with ranks from r on go one by one into the sequences from s
on, at an offset. Its size depends on the lengths that occur, not on the number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch
from gatefold.llm.ranks import with_ranks
from gatefold.llm.tokens import VOCABULARY, encoder
from gatefold.llm.words import pieces as slices

#: Tokens of a sequence; id behind each document.
CAPACITY, END = 2048, 0
#: (groups, share): lengths above capacity/share are large and fall into so many groups. Each is planned, the best is kept.
SCHEMES = ((24, 2), (40, 3), (40, 6))
#: Rounds of column generation.
ROUNDS = 400


def tokenized(docs: DataFrame, doc_id: str, text: str, vocabulary: str, capacity: int, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit numbers)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema[0], *T._parse_datatype_string("piece int, start long, length int, ids_crc32 long" + ", ids binary" * with_ids).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(vocabulary).encode, np.array([end], "<u4").tobytes()
        for batch in batches:
            for part, texts in slices(batch, "text"):
                of, out = [], []
                for d, ids in enumerate(encode([t.decode() for t in texts])):
                    ids += last
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    start, piece = 0, 0
                    while start < n:
                        length = capacity if piece else min(n, first)
                        own = ids[4 * start : 4 * (start + length)]
                        of.append(d)
                        out.append((piece, start, length, zlib.crc32(own), *[own] * with_ids))
                        start, piece = start + length, piece + 1
                columns = list(zip(*out, strict=True))
                kinds = pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], schema.names)

    return rows.mapInArrow(work, schema)


def _groups(large: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """(length, count), descending, cut into groups of equal cardinality; a group is a list of (length, count)."""
    total = sum(n for _, n in large)
    each = max(1, -(-total // most))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration with the largest sum of prices, by a knapsack over capacities."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(sizes.min())
    for c in range(least, capacity + 1):
        fits = np.flatnonzero(sizes <= c)
        worth = value[c - sizes[fits]] + prices[fits]
        k = int(worth.argmax())
        if worth[k] > value[c - 1] + 1e-12:
            value[c], choice[c] = worth[k], fits[k]
        else:
            value[c] = value[c - 1]
    pattern, c = np.zeros(len(sizes), np.int64), capacity
    while c >= least:
        if choice[c] < 0 or value[c] == value[c - 1]:
            c -= 1
            continue
        pattern[choice[c]] += 1
        c -= sizes[choice[c]]
    return float(value[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, covering no more than the demand: the linear optimum, rounded down."""
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # a configuration in each column
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amount = inverse @ demand
        prices = np.maximum(inverse.sum(0), 0)  # each configuration costs one sequence
        worth, pattern = _best_pattern(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(ratio.argmin())
        if not np.isfinite(ratio[leaves]):
            break
        basis[:, leaves] = pattern
    amount = np.linalg.solve(basis, demand)
    left, out = demand.astype(np.int64).copy(), []
    for k in np.argsort(-amount):
        pattern = np.round(basis[:, k]).astype(np.int64)
        used = pattern > 0
        times = int(min(np.floor(amount[k] + 1e-6), (left[used] // pattern[used]).min())) if used.any() else 0
        if times > 0:
            left -= times * pattern
            out.append((pattern, times))
    assert m == len(left) and (left >= 0).all()
    return out


class _Bins:
    """Runs of consecutive sequences that have the same free space."""

    def __init__(self, capacity: int):
        self.capacity, self.next = capacity, 0
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.spaces: list[int] = []
        self.segments: list[tuple[int, int, int, int, int]] = []  # length, rank, count, sequence, offset
        self.used: dict[int, int] = {}

    def open(self, n: int) -> int:
        first, self.next = self.next, self.next + n
        return first

    def leave(self, free: int, first: int, n: int) -> None:
        if n and free:
            if free not in self.free:
                self.free[free] = []
                insort(self.spaces, free)
            self.free[free].append((first, n))

    def put(self, length: int, n: int, first: int, offset: int) -> None:
        rank = self.used.get(length, 0)
        self.segments.append((length, rank, n, first, offset))
        self.used[length] = rank + n

    def best_fit(self, length: int, n: int) -> None:
        """Puts n pieces of one length where the least space is left that holds them."""
        while n:
            at = bisect_left(self.spaces, length)
            if at < len(self.spaces):
                free = self.spaces[at]
                first, bins = self.free[free].pop()
                if not self.free[free]:
                    del self.free[free], self.spaces[at]
            else:
                free, bins = self.capacity, -(-n // (self.capacity // length))
                first = self.open(bins)
            each = free // length
            full = min(bins, n // each)
            for k in range(each if full else 0):
                self.put(length, full, first, self.capacity - free + k * length)
            n -= full * each
            self.leave(free - each * length, first, full)
            first, bins = first + full, bins - full
            if bins and n:  # fewer than a sequence takes
                for k in range(n):
                    self.put(length, 1, first, self.capacity - free + k * length)
                self.leave(free - n * length, first, 1)
                first, bins, n = first + 1, bins - 1, 0
            self.leave(free, first, bins)


def plan(counts: dict[int, int], capacity: int = CAPACITY, schemes: tuple[tuple[int, int], ...] = SCHEMES) -> tuple[np.ndarray, int]:
    """Segments (length, rank, count, sequence, offset) and the number of sequences."""
    return min((_plan(counts, capacity, *s) for s in schemes), key=lambda x: x[1])


def _plan(counts: dict[int, int], capacity: int, groups: int, small_share: int) -> tuple[np.ndarray, int]:
    bins = _Bins(capacity)
    counts = {length: n for length, n in counts.items() if n}
    if n := counts.pop(capacity, 0):
        bins.put(capacity, n, bins.open(n), 0)
    large = sorted(((x, n) for x, n in counts.items() if x > capacity // small_share), reverse=True)
    rest: dict[int, int] = {x: n for x, n in counts.items() if x <= capacity // small_share}
    if large:
        grouped = _groups(large, groups)
        heads: dict[int, list[list[tuple[int, int]]]] = {}
        for g in grouped:
            heads.setdefault(g[0][0], []).append(g)
        sizes = np.array(sorted(heads, reverse=True), np.int64)
        stock = [[x for g in heads[int(s)] for x in g] for s in sizes]
        demand = np.array([sum(n for _, n in s) for s in stock], float)
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [k for k, n in enumerate(pattern) for _ in range(n)]
            left = times
            while left:  # a run of sequences in which every slot has one actual length
                lengths, run = [], left
                need = {k: slots.count(k) for k in set(slots)}
                for k in slots:
                    lengths.append(stock[k][-1][0])
                    run = min(run, stock[k][-1][1] // need[k])
                if not run:  # a length runs out inside one sequence
                    run, lengths = 1, []
                    for k in slots:
                        length, n = stock[k][-1]
                        lengths.append(length)
                        stock[k][-1] = (length, n - 1)
                        if n == 1:
                            stock[k].pop()
                else:
                    for k in slots:
                        length, n = stock[k][-1]
                        stock[k][-1] = (length, n - run)
                    for k in set(slots):
                        if not stock[k][-1][1]:
                            stock[k].pop()
                first, offset = bins.open(run), 0
                for length in lengths:
                    bins.put(length, run, first, offset)
                    offset += length
                bins.leave(capacity - offset, first, run)
                left -= run
        for s in stock:
            for length, n in s:
                rest[length] = rest.get(length, 0) + n
    for length in sorted(rest, reverse=True):
        bins.best_fit(length, rest[length])
    return np.array(sorted(bins.segments), np.int64).reshape(-1, 5), bins.next


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every document.

    A document is its token ids and END; one over ``capacity`` is cut so that all pieces but the first have just that
    length. Null and empty texts are the END alone. Equal rows are packed each for themselves; an empty table gives none."""
    rows = scratch.stored(with_ranks_of(tokenized(docs, doc_id, text, vocabulary or public_tokenizers.path(VOCABULARY), capacity, with_ids=with_ids), capacity))
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _ = plan(counts, capacity)
    shared = docs.sparkSession.sparkContext.broadcast(segments)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "rank"] + T._parse_datatype_string("sequence_id long, offset long").fields)
    schema["length"].dataType = T.LongType()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = shared.value
        key = seg[:, 0] << 44 | seg[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "rank"} | {"length": pa.array(length), "sequence_id": pa.array(seg[at, 3] + rank - seg[at, 1]), "offset": pa.array(seg[at, 4])}
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema.names)

    return rows.mapInArrow(place, schema)


def with_ranks_of(pieces: DataFrame, capacity: int) -> DataFrame:
    """Each piece's rank among those of its length."""
    return with_ranks(pieces, "length", capacity + 1)
