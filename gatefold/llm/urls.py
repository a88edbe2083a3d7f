"""URL filters: a sorted array of 64-bit xxhash keys, memory-mapped by every worker and probed by binary search.

A rule is a host and a path; it fits that host and its subdomains where the url's path starts with the rule's. The list
is one file: the sorted keys, and beside each the place of its full rule, which is compared before a hit counts, so a
collision of digests never decides. Spark ships the file to each executor once; its pages are shared by the workers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch

#: (rule, verdict). A rule is a host and a path from the first '/'.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: The verdict where no rule fits.
DEFAULT = "allow"
MAGIC = np.uint64(0x31545349_4C455552)


def _key(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode())


def pack(rules: Sequence[tuple[str, str]]) -> bytes:
    """The list as one file: header (magic, rules, lengths of paths, bytes of strings), keys, string ends, verdicts, lengths, strings.
    Of equal rules with different verdicts 'block' stands."""
    merged: dict[str, str] = {}
    for rule, verdict in rules:
        merged[rule] = "block" if "block" in (verdict, merged.get(rule)) else verdict
    rows = sorted((_key(r), r.encode(), v) for r, v in merged.items())
    ends = np.cumsum([len(r) for _, r, _ in rows], dtype=np.uint64)
    lengths = sorted({len(r) - len(host) for _, r, _ in rows for host in [r.split(b"/", 1)[0]]})
    text = b"".join(r for _, r, _ in rows)
    head = np.array([MAGIC, len(rows), len(lengths), len(text)], np.uint64)
    return b"".join((head.tobytes(), np.array([k for k, _, _ in rows], np.uint64).tobytes(), ends.tobytes(), np.array([v == "block" for *_, v in rows], np.uint64).tobytes(), np.array(lengths, np.uint64).tobytes(), text))


class DigestList:
    """A packed list, mapped from its file."""

    def __init__(self, path: str):
        words = np.memmap(path, np.uint64, "r", shape=(4,))
        if words[0] != MAGIC:
            raise ValueError(f"{path} is no rule list")
        n, m, size = (int(x) for x in words[1:])
        body = np.memmap(path, np.uint64, "r", 32, (3 * n + m,)) if n else np.zeros(0, np.uint64)
        self.keys, self.ends, self.block = body[:n], body[n : 2 * n], body[2 * n : 3 * n]
        self.lengths = [int(x) for x in body[3 * n :]]
        self.longest = int(np.diff(self.ends, prepend=np.uint64(0)).max()) if n else 0
        self.text = np.memmap(path, np.uint8, "r", 32 + 8 * (3 * n + m), (size,)) if size else np.zeros(0, np.uint8)

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """For each candidate its place in the list or -1."""
        out = np.full(len(candidates), -1, np.int64)
        if not len(self.keys) or not candidates:
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys).tolist():
            for k in range(int(at[i]), len(self.keys)):  # several rules may share a digest
                if self.keys[k] != keys[i]:
                    break
                if self.text[int(self.ends[k - 1]) if k else 0 : int(self.ends[k])].tobytes() == candidates[i]:
                    out[i] = k
                    break
        return out

    def judge(self, host: list[str], path: list[str]) -> list[tuple[str, str] | None]:
        """The longest rule that fits each url, with its verdict."""
        of, candidates = [], []
        for i, (h, p) in enumerate(zip(host, path, strict=True)):
            if not h or not p:
                continue
            own, p = h.encode(), p.encode()
            at = len(own) + 1
            while at > 0:  # the host's last labels, one more each time, as far as a rule reaches
                at = own.rfind(b".", 0, at - 1) + 1
                suffix = own[at:]
                if len(suffix) > self.longest:
                    break
                for n in self.lengths:
                    if n <= len(p):
                        of.append(i)
                        candidates.append(suffix + p[:n])
        best: list[tuple[str, str] | None] = [None] * len(host)
        for i, c, k in zip(of, candidates, self.probe(candidates).tolist(), strict=True):
            if k >= 0 and (best[i] is None or len(c) > len(best[i][0].encode())):
                best[i] = c.decode(), "block" if self.block[k] else "allow"
        return best


def ship(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> str:
    """Writes the list to the shared folder and has Spark bring it to every executor; returns its name there."""
    path = f"{scratch.new_path(spark)}.rules"
    scratch._made.append((spark, path))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(pack(rules)))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def parts(url: str) -> tuple:
    """Host and path columns of a url column."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"\A([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of each page.

    A null url, and one without '://', has an empty host and path, no rule and the default verdict. Of two rules of equal
    length that fit, the one with the longer host wins. Repeated rows give equal rows; an empty list decides nothing."""
    name = ship(pages.sparkSession, rules)
    host, path = parts(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    schema = T.StructType([*rows.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = DigestList(SparkFiles.get(name))
        for batch in batches:
            found = rules.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x and x[0] for x in found], pa.string()), pa.array([x[1] if x else default for x in found], pa.string())], [*batch.schema.names, "rule", "verdict"])

    return rows.mapInArrow(probe, schema)
