"""Nearest neighbours by Hamming distance within equal keys, and cell-wise differences."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatefold.sources import shared


def hamming(a: str | Column, b: str | Column) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


#: Substrings of a fingerprint and bits of each; how many bits of a substring are turned at most; queries scanned at a time.
PARTS, WIDTH, TURNED, SCANNED = 4, 16, 2, 4096


def _substrings(bits: str) -> Column:
    return F.array(*[F.call_function("shiftrightunsigned", F.col(bits).cast("long"), F.lit(WIDTH * k)).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long")).cast("int") for k in range(PARTS)])


def nearest(queries: DataFrame, corpus: DataFrame, block: list[str], bits: str, ident: str, k: int) -> DataFrame:
    """The k nearest rows of the corpus for each query by the Hamming distance of 64 bits, among those with equal ``block``
    columns: query, neighbour, distance, place; ties by the lower id. Ids are longs; a row is no neighbour of its own id.

    Exact, by substrings: two fingerprints r bits apart agree in one of PARTS substrings but for r // PARTS bits. Round by
    round one more bit of a query's substrings is turned, and what stands under the result in an index by (block, place,
    substring) is a candidate; a query is done when its k-th candidate is nearer than anything not yet looked up could be.
    The index shares out a block, however many rows are of it. Queries that need more than TURNED bits, for which look-ups
    would cost more than they save, scan the corpus in blocks of SCANNED, each task keeping k rows for each query.

    Null ids, fingerprints and block columns match nothing; rows of one id are one row each."""
    pending = shared.stored(queries.select(F.col(ident).cast("long").alias("query"), F.col(bits).cast("long").alias("_a"), *[F.col(c).alias(f"_q_{c}") for c in block]).na.drop().distinct())
    rows = shared.stored(corpus.select(F.col(ident).cast("long").alias("neighbour"), F.col(bits).cast("long").alias("_b"), *block).na.drop())
    index = shared.stored(rows.select("*", F.posexplode(_substrings("_b")).alias("_p", "_key")))
    on = (F.col("_p") == F.col("_at")) & (F.col("_key") == F.col("_want")) & (F.col("query") != F.col("neighbour"))
    for c in block:
        on = on & (F.col(f"_q_{c}") == F.col(c))
    best = Window.partitionBy("query").orderBy("distance", "neighbour")
    found: DataFrame | None = None
    over: list[DataFrame] = []
    for turned in range(TURNED + 1):
        masks = F.array(*[F.lit(sum(1 << b for b in bs)) for bs in combinations(range(WIDTH), turned)])
        asked = pending.select("*", F.posexplode(_substrings("_a")).alias("_at", "_s")).select("*", F.explode(masks).alias("_m")).withColumn("_want", F.col("_s").bitwiseXOR(F.col("_m")))
        near = asked.join(index, on).select("query", "neighbour", "_b", hamming("_a", "_b").cast("int").alias("distance"))
        if found is not None:
            near = near.union(found.join(pending.select(F.col("query").alias("_x")), F.col("query") == F.col("_x"), "left_semi"))
        # a row is found in several of its substrings: those are equal rows here, unlike rows of one id and other bits
        found = shared.stored(near.distinct().withColumn("_nth", F.row_number().over(best)).filter(F.col("_nth") <= k).drop("_nth"))
        done = found.groupBy(F.col("query").alias("_x")).agg(F.count(F.lit(1)).alias("_n"), F.max("distance").alias("_far")).filter((F.col("_n") >= k) & (F.col("_far") < PARTS * (turned + 1))).select("_x")
        over.append(found.join(done, F.col("query") == F.col("_x"), "left_semi").select("query", "neighbour", "distance"))
        pending = shared.stored(pending.join(done, F.col("query") == F.col("_x"), "left_anti"))
        left = pending.count()
        if not left:
            break
    blocks = -(-left // SCANNED)
    for n in range(blocks):
        own = pending.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == n).toArrow()
        shared_queries = corpus.sparkSession.sparkContext.broadcast(own)
        over.append(rows.select("neighbour", "_b", *block).mapInArrow(lambda batches, own=shared_queries: _scanned(batches, own, k), "query long, neighbour long, distance int"))
    out = reduce(DataFrame.union, over)
    return out.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def _scanned(batches: Iterator[pa.RecordBatch], own, k: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of a task's rows for each query of a block."""
    table = own.value
    query, bits = (np.asarray(table.column(c)) for c in ("query", "_a"))
    groups: dict[tuple, np.ndarray] = {}
    for n, key in enumerate(zip(*(table.column(c).to_pylist() for c in table.column_names[2:]), strict=True) if len(table.column_names) > 2 else [()] * len(query)):
        groups.setdefault(key, []).append(n)
    heap: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(query)
    for batch in batches:
        ids, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        places: dict[tuple, list[int]] = {}
        for n, key in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if batch.num_columns > 2 else [()] * len(ids)):
            places.setdefault(key, []).append(n)
        for key, mine in places.items():
            at = np.array(mine)
            for q in groups.get(key, ()):
                far = np.bitwise_count((b[at] ^ bits[q]).view(np.uint64)).astype(np.int64)
                keep = ids[at] != query[q]
                d, i = np.concatenate((heap[q][0], far[keep])), np.concatenate((heap[q][1], ids[at][keep]))
                order = np.lexsort((i, d))[:k]
                heap[q] = d[order], i[order]
    sizes = [len(d) for d, _ in heap]
    if sum(sizes):
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query, sizes)), pa.array(np.concatenate([i for _, i in heap])), pa.array(np.concatenate([d for d, _ in heap]).astype(np.int32))], ["query", "neighbour", "distance"])


def sign_bits(vector: str, n: int = 64) -> Column:
    """A long with a bit for each of n numbers, 64 at most, that is positive."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(F.when(F.get(F.col(vector), i) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))


def differing(a: Column, b: Column) -> Column:
    """Places, from 0, at which two arrays differ."""
    return F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: F.get(a, i) != F.get(b, i))
