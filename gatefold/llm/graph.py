"""Classes of similar members of buckets, and connected components of links; both held in tables.

The first bands' buckets come first; they join most copies, and a bucket whose members are then of one class is done, as no
further link could change a class. Members of large buckets are first compared with a leader, another one in each of STARS
rounds: that joins copies, however many, in as many comparisons. What is left is dealt into chunks of bounded size, and each
two chunks of a bucket are one group; small buckets share a group. In a group arrays compare all members of different
classes at once, and only links that join classes leave the task. So no link is lost, no task holds more than two chunks,
and no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatefold.llm import scratch

#: Rounds with leaders, and members from which a bucket has them.
STARS, LARGE = 2, 1024
#: Members and units of size of a chunk, about; members of a group of small buckets, about.
CHUNK, CHUNK_SIZE, PACK = 256, 1 << 18, 64
#: Columns of a block of the matrix product that compares a group.
WIDTH = 4096
#: Slots of the bitmap of ``marked``, 4096 to a row; rows of a small table that one task writes, and the fewest tasks that write one.
SLOTS, OF_TASK, TASKS = 1 << 26, 1 << 17, 12
#: Hashes of a range that ``recurring`` merges at once, about; those that it sorts at once.
PART, SORTED = 1 << 18, 1 << 21


def classes(members: DataFrame, payload: DataFrame, verified: Callable[[DataFrame], DataFrame], joined: Callable[[pa.Table], pa.Table], first: int, chunk: int = CHUNK, chunk_size: int = CHUNK_SIZE, large: int = LARGE, pack: int = PACK) -> DataFrame:
    """(node, component) of all members (band, bucket, uid, size, n of the bucket) that similar pairs within buckets connect. Stored.

    ``first``: bands that come first. ``verified`` (a, b) -> those pairs that are similar. ``joined``: Arrow function of a
    group with the columns of ``payload`` (uid, ...) behind bucket, uid, component and chunk; it returns links (a, b) between
    members of one bucket and different components."""
    found: list[DataFrame] = []
    labels: DataFrame | None = None
    rows = members.count()
    carried = [c for c in payload.columns if c != "uid"]

    def group(table: pa.Table) -> pa.Table:
        return joined(table.select(["bucket", "uid", "component", "chunk", *carried]))

    for part in (members.filter(F.col("band") < first), members.filter(F.col("band") >= first)):
        crowds = part.filter(F.col("n") > large)
        for k in range(STARS if crowds.limit(1).count() else 0):
            own = named(crowds, labels)
            lead = own.groupBy(F.col("bucket").alias("b")).agg(F.min_by(F.struct("uid", "component"), F.xxhash64("bucket", "uid", F.lit(k))).alias("lead"), F.min("component").alias("low"), F.max("component").alias("high"))
            asked = own.join(lead.filter("low <> high").select("b", "lead"), F.col("bucket") == F.col("b")).filter("component <> lead.component")
            pairs = asked.select(F.greatest("uid", "lead.uid").alias("a"), F.least("uid", "lead.uid").alias("b")).distinct()
            found.append(scratch.stored(verified(pairs).select("a", "b")))
            labels = components(reduce(DataFrame.union, found))
        own = scratch.stored(few_tasks(named(part, labels), rows))
        sizes = own.groupBy(F.col("bucket").alias("b")).agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
        mixed = scratch.stored(few_tasks(sizes.filter("low <> high").select("b", "n", "total", F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("total") / chunk_size)).cast("int").alias("chunks")), rows))
        few = mixed.filter("chunks = 1").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        packs = max(1, few.n // pack, few.total // chunk_size)
        asked = own.join(mixed.select("b", "chunks"), F.col("bucket") == F.col("b")).select("bucket", "uid", "component", "chunks", F.pmod(F.xxhash64("uid"), "chunks").cast("int").alias("chunk"))
        asked = scratch.stored(few_tasks(asked, rows))
        shipped = asked.join(likely(payload, asked, "uid").withColumnRenamed("uid", "of"), F.col("uid") == F.col("of")).drop("of")
        spread = shipped.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        held = F.when(F.col("chunks") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(packs)))
        groups = spread.select(held.alias("pack"), F.when(F.col("chunks") > 1, F.least("chunk", "other")).otherwise(-1).alias("i"), F.greatest("chunk", "other").alias("j"), "bucket", "uid", "component", "chunk", *carried)
        found.append(scratch.stored(groups.groupBy("pack", "i", "j").applyInArrow(group, "a long, b long")))
        scratch.release(own, mixed, asked)
        labels = components(reduce(DataFrame.union, found))
    return labels


def named(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(bucket, uid, size) with the component of each uid, itself if it has no link."""
    if labels is None:
        return members.select("bucket", "uid", "size", F.col("uid").alias("component"))
    return members.join(labels, F.col("uid") == F.col("node"), "left").select("bucket", "uid", "size", F.coalesce("component", "uid").alias("component"))


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more partitions than it takes to write that many: a small table is few files."""
    return df.coalesce(max(TASKS, rows // OF_TASK))


def marked(table: DataFrame, wanted: DataFrame, *keys: str, slots: int = SLOTS) -> DataFrame:
    """``table`` with ``maybe``: true for all rows whose ``keys`` are those of a row of ``wanted``, and for few others.

    A bitmap of the wanted keys' hashes, of at most ``slots`` bits whatever their number, is broadcast, so that no row of
    ``table`` is shuffled. Where there are many more wanted keys than slots, most rows are marked. Null keys are like others."""
    slot = F.pmod(F.xxhash64(*keys), F.lit(slots))
    place, word, bit = F.shiftright(slot, 12), F.pmod(F.shiftright(slot, 6), F.lit(64)).cast("int"), F.pmod(slot, F.lit(64)).cast("int")
    words = wanted.select(place.alias("place"), word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit")).groupBy("place", "word").agg(F.bit_or("bit").alias("bits"))
    held = words.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("held"))
    # an array of 64 words is a tenth of as many rows to every executor
    bitmap = held.select("place", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.col("held")[k], F.lit(0).cast("long"))).alias("bits"))
    found = table.join(F.broadcast(bitmap), place == F.col("place"), "left")
    return found.select(*table.columns, F.coalesce(F.getbit(F.get("bits", word), bit) == 1, F.lit(False)).alias("maybe"))


def likely(table: DataFrame, wanted: DataFrame, *keys: str, slots: int = SLOTS) -> DataFrame:
    """The rows of ``table`` whose ``keys`` ``wanted`` has, and few others: what a join with ``wanted`` needs to shuffle."""
    return marked(table, wanted, *keys, slots=slots).filter("maybe").drop("maybe")


def among(table: DataFrame, wanted: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``table`` whose uid is one of ``wanted``, exactly."""
    asked = wanted.select(F.col("uid").alias("m")).distinct()
    # an inner join of distinct uids: Spark would move a semi join below the bitmap's, and shuffle the whole table for it
    return likely(table, wanted, "uid", slots=slots).join(asked, F.col("uid") == F.col("m")).select(*table.columns)


def shared(entries: DataFrame, rows: int) -> DataFrame:
    """``entries`` (band, bucket, uid, size) of about ``rows`` uids, those in buckets of more than one, with n of the bucket. Stored.

    Few buckets are shared, so a bitmap of these drops the other entries before the join that shuffles them."""
    counts = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = scratch.stored(few_tasks(counts, rows))
    out = scratch.stored(likely(entries, many, "bucket").join(many.withColumnRenamed("bucket", "b"), F.col("bucket") == F.col("b")).select("band", "bucket", "uid", "size", "n"))
    scratch.release(many)
    return out


def shared_of(rows: DataFrame, columns: list[str], n: int) -> DataFrame:
    """What ``shared`` finds of ``rows`` (uid, size and a bucket in each of ``columns``, none of them null), about ``n``. Stored."""
    many = scratch.stored(few_tasks(recurring(rows.select(*columns), n * len(columns)), n), hashes=True)
    entries = rows.select(F.posexplode(F.array(*columns)).alias("band", "bucket"), "uid", "size")
    out = scratch.stored(likely(entries, many, "bucket").join(many.withColumnRenamed("bucket", "b"), F.col("bucket") == F.col("b")).select("band", "bucket", "uid", "size", "n"))
    scratch.release(many)
    return out


def recurring(values: DataFrame, about: int) -> DataFrame:
    """(bucket, n) of the 64-bit hashes that stand more than once in the columns of ``values``, which hold ``about`` so many.

    A task sorts and counts what it reads and ships it as arrays, one for each range of hashes, in place of a row for each
    hash; a range holds some PART hashes, each once for SORTED that a task has read, so no hash makes it large."""
    parts = 1 << max(6, (about // PART).bit_length())
    bounds = (np.arange(1, parts, dtype=np.uint64)) << np.uint64(64 - parts.bit_length() + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held += [np.asarray(c).view(np.uint64) for c in batch.columns]
            if held and (batch is None or sum(map(len, held)) >= SORTED):
                value, n = np.unique(np.concatenate(held), return_counts=True)
                held = []
                at = np.concatenate(([0], np.searchsorted(value, bounds), [len(value)])).tolist()
                n = n.astype(np.int64)
                full = [k for k in range(parts) if at[k] < at[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array([x[at[k] : at[k + 1]].tobytes() for k in full], pa.binary()) for x in (value, n))], ["part", "value", "n"])

    def merge(group: pa.Table) -> pa.Table:
        value, n = (np.frombuffer(b"".join(c.to_pylist()), np.int64) for c in group.columns[1:])
        order = np.argsort(value)
        value, n = value[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        total = np.add.reduceat(n, first)
        return pa.table({"bucket": pa.array(value[first[total > 1]]), "n": pa.array(total[total > 1])})

    return values.mapInArrow(pack, "part int, value binary, n binary").groupBy("part").applyInArrow(merge, "bucket long, n long")


def common(owner: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each two of n texts the sum of the lesser weights of what both hold (owner, h, weight).

    A thing h of which texts have several weights is as many columns: one for each step from a weight to the next, held by
    the texts that reach it. A column is worth its step, and a product of matrices sums what two texts both hold."""
    total = np.zeros((n, n), np.float32)
    order = np.lexsort((weight, h))
    owner, h, weight = owner[order], h[order], weight[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(h)))
    shared = np.repeat(size > 1, size)  # what one text alone holds is not common
    owner, weight, size = owner[shared], weight[shared], size[size > 1]
    if not len(size):
        return total
    first = np.cumsum(size) - size
    step = np.diff(weight, prepend=0)
    step[first] = weight[first]
    rise = step > 0
    rise[first] = True
    top = np.cumsum(rise) - 1
    lowest = np.repeat(top[first], size)
    held = top - lowest + 1
    column = np.repeat(lowest - (np.cumsum(held) - held), held) + np.arange(held.sum())
    row, worth = np.repeat(owner, held), np.sqrt(step[rise]).astype(np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, len(worth), WIDTH):
        a, b = np.searchsorted(column, (low, low + WIDTH))
        block = np.zeros((n, min(WIDTH, len(worth) - low)), np.float32)
        block[row[a:b], column[a:b] - low] = worth[column[a:b]]
        total += block @ block.T
    return total


def apart(bucket: np.ndarray, component: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Which members of a group are to be compared: those of one bucket, different components and, if it has two chunks, chunks."""
    out = (component[:, None] != component[None, :]) & (bucket[:, None] == bucket[None, :])
    return out & (chunk[:, None] != chunk[None, :]) if len(chunk) and chunk.min() != chunk.max() else out


def forest(similar: np.ndarray, component: np.ndarray) -> list[tuple[int, int]]:
    """Of the links of a symmetric matrix those that join components, none of which closes a circle."""
    label, out = np.unique(component, return_inverse=True)[1], []
    for x in np.flatnonzero(similar.any(1)):
        near = np.flatnonzero(similar[x] & (label != label[x]))
        if len(near):
            new, first = np.unique(label[near], return_index=True)
            out += [(int(x), int(y)) for y in near[first]]
            label[np.isin(label, new)] = label[x]
    return out


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, component): for each node that has a link, the least node it is connected with. Stored.

    Each round hooks every node to its least neighbour, shortens the chains that this makes and draws links between what is
    left of them, so the graph shrinks by more than half; the rounds' maps are put together at the end. Every round writes
    its tables, so no lineage grows and a lost executor costs one round."""
    rows = links.count()
    edges = scratch.stored(few_tasks(_drawn(links.select("a", "b")), rows))
    maps: list[DataFrame] = []
    while not maps or edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooked = scratch.stored(few_tasks(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), rows))
        flat = hooked
        for _ in range(2):
            flat = _over(flat, hooked)
        maps.append(scratch.stored(few_tasks(flat, rows)))
        first, second = (maps[-1].select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("a", "x"), ("b", "y")))
        after = scratch.stored(few_tasks(_drawn(edges.join(first, "a").join(second, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))), rows))
        scratch.release(edges, hooked)
        edges = after
    out = maps.pop()
    while maps:  # a map's components are nodes of the next, or at their root already
        out = _over(maps.pop(), out)
    return scratch.stored(few_tasks(out, rows))


def _drawn(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _over(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` with each component replaced by its own in ``further``, if it has one."""
    more = further.select(F.col("node").alias("over"), F.col("component").alias("last"))
    return labels.join(more, F.col("component") == F.col("over"), "left").select("node", F.coalesce("last", "component").alias("component"))
