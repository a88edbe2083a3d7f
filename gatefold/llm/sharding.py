"""Sharding: a minimax contiguous partition of ordered, atomic groups.

Groups are rows of equal text, ordered by the MD5 digest of the text. The smallest feasible shard capacity is found by
binary search; a capacity is checked greedily, by filling each shard as far as it goes. The driver never holds one number
for each group: it holds sums of digest ranges, in which a cut is known up to a range, and asks for finer sums of just
those ranges where a cut may fall, until the capacity is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch
from gatefold.llm.ranks import with_ranks

SHARDS = 8
#: Hex digits of the digest by which one refinement splits a range, and digits of the digest.
STEP, DIGITS = 3, 32


def measured(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, size, text_crc32, digest; a null text is one of its own, of size 1."""
    body = F.encode(F.col(text).cast("string"), "UTF-8")
    none = F.encode(F.lit(""), "UTF-8")
    return docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(body, none)).alias("text_crc32"), F.md5(F.coalesce(body, none)).alias("digest"))


def _fill(sums: list[tuple[str, int, bool]], shards: int, capacity: int, exact: bool) -> list[int] | None:
    """Cuts (how many ranges lie before each) if the ranges go into the shards; else None. exact: a shard ends with a range;
    otherwise it may end inside a range of several groups, as if they could be cut anywhere."""
    ends = np.cumsum([n for _, n, _ in sums])
    total, at, cuts = int(ends[-1]), 0, []
    for _ in range(shards):
        if at >= total:
            cuts.append(len(sums))
            continue
        k = int(np.searchsorted(ends, at + capacity, "right"))
        reached = int(ends[k - 1]) if k else 0
        if not exact and k < len(sums) and not sums[k][2]:
            reached = at + capacity
        if reached <= at:
            return None
        at = reached
        cuts.append(k)
    return cuts if at >= total else None


def _smallest(sums: list[tuple[str, int, bool]], shards: int, exact: bool) -> int:
    total = sum(n for _, n, _ in sums)
    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if _fill(sums, shards, middle, exact) is not None else (middle + 1, high)
    return low


def _in_doubt(sums: list[tuple[str, int, bool]], shards: int, low: int, high: int) -> list[str]:
    """Ranges of several groups in which a shard may end, for a capacity from low to high."""
    ends = np.cumsum([n for _, n, _ in sums])
    least = most = 0
    doubt = []
    for _ in range(shards):
        k = int(np.searchsorted(ends, least + low, "right"))
        least = max(least, int(ends[k - 1]) if k else 0)
        far = int(np.searchsorted(ends, most + high, "right"))
        most = int(ends[far - 1]) if far == len(sums) or sums[far][2] and far else most + high
        doubt += [sums[x][0] for x in range(k, min(far, len(sums) - 1) + 1) if not sums[x][2]]
    return list(dict.fromkeys(doubt))


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The smallest capacity, and for each shard but the last the first digest prefix behind it."""
    sums: list[tuple[str, int, bool]] = []
    ranges, depth = [""], 0
    while True:
        depth += STEP
        inside = groups if ranges == [""] else groups.join(F.broadcast(groups.sparkSession.createDataFrame([(x,) for x in ranges], "prefix string")), F.substring("digest", 1, depth - STEP) == F.col("prefix"), "left_semi")
        finer = [(r.prefix, r.size, r.least == r.most) for r in inside.groupBy(F.substring("digest", 1, depth).alias("prefix")).agg(F.sum("size").alias("size"), F.min("digest").alias("least"), F.max("digest").alias("most")).collect()]
        if not finer:
            return 0, ["~"] * (shards - 1)
        sums = sorted([x for x in sums if x[0] not in set(ranges)] + finer)
        low, high = _smallest(sums, shards, False), _smallest(sums, shards, True)
        ranges = [] if low == high else [x for x in _in_doubt(sums, shards, low, high) if len(x) == depth]
        if not ranges or depth >= DIGITS:
            found = _fill(sums, shards, high, True)
            return high, [sums[k][0] if k < len(sums) else "~" for k in found[:-1]]


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null under this law).

    Sizes are UTF-8 bytes plus 1; null texts weigh 1 and are grouped with empty ones. Equal texts, and so repeated rows, share a shard and have
    slots of their own. An empty table gives no rows; with fewer groups than shards the last shards are empty."""
    rows = scratch.stored(measured(docs, doc_id, text))
    groups = scratch.stored(rows.groupBy("digest").agg(F.sum("size").alias("size")))
    _, bounds = cuts(groups, shards)
    placed = F.lit(0)
    for b in bounds:
        placed = placed + (F.col("digest") >= F.lit(b)).cast("int")
    ranked = with_ranks(rows.withColumn("shard", placed).drop("digest"), "shard", shards)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
