"""WARC archives: gzip members of one record each, long records in segments, payloads in chunked transfer framing.

Writing: each task appends records to archives of its own in the shared folder and reports their paths; only archives of
tasks that succeeded are in the report, so a task that ran twice adds nothing. Reading: each archive is streamed; blocks in
one record are decoded where they are read, segments are grouped by origin identifier, put in order of their numbers,
checked against the total length, joined and decoded.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch

#: Payloads from this many bytes on are written once; longest block of a record; bytes of a chunk; bytes of an archive.
LEAST, SEGMENT, CHUNK, ARCHIVE = 100, 32 << 10, 8 << 10, 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"

_RECORD = "origin string, segment int, total long, page string, kind string, refers_to string, digest string, length long, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing: sizes in hexadecimal, each chunk, and the empty one."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of chunked framing; extensions of a chunk and trailers are skipped, broken framing raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message: what follows its head, without chunked framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))])
    press = zlib.compressobj(1, wbits=31)
    return press.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n") + press.flush()


def records(name: str, page: str | None, payload: bytes, digest: str, refers_to: str | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page: a revisit, a response, or a response and its continuations."""
    target = [("WARC-Target-URI", f"urn:page:{page}")] if page is not None else []
    common = [*target, ("WARC-Payload-Digest", f"sha256:{digest}")]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", f"urn:page:{refers_to}")], _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload))
        return
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    many = len(block) > segment
    for k, i in enumerate(range(0, len(block), segment)):
        part = block[i : i + segment]
        fields = [("WARC-Type", "continuation" if k else "response"), ("WARC-Record-ID", f"<{name}:{k}>" if k else f"<{name}>"), *common]
        fields += [("WARC-Segment-Number", k + 1)] * many + [("WARC-Segment-Origin-ID", f"<{name}>")] * bool(k)
        fields += [("WARC-Segment-Total-Length", len(block))] * bool(k and i + segment >= len(block))
        yield _record(fields, part)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _read(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of the records of one archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("the archive ends within a record")
        yield head, block


def planned(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """page, payload, digest, refers_to of each page; refers_to is null for responses.

    Only digests that occur more than once are joined back. They are written first, so that their real size decides
    whether Spark sends them to all tasks or shuffles both sides (and then splits a frequent digest)."""
    rows = pages.select(F.col(page_id).alias("page"), F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.filter(F.octet_length("payload") >= LEAST).groupBy("digest").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n"))
    many = scratch.stored(groups.filter("n > 1 AND first IS NOT NULL").select(F.col("digest").alias("of"), "first"))
    joined = rows.join(many, F.col("digest") == F.col("of"), "left")
    return joined.select(F.col("page").cast("string").alias("page"), "payload", "digest", F.when(~F.col("page").eqNullSafe(F.col("first")), F.col("first")).cast("string").alias("refers_to"))


def write(pages: DataFrame, page_id: str = "page_id", html: str = "html", archive: int = ARCHIVE) -> DataFrame:
    """Writes the archives; a row for each: path, records, bytes."""
    folder = scratch.new_path(pages.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, stream, number, count, done = [], None, 0, 0, 0

        def close() -> None:
            if stream:
                stream.close()
                out.append((path, count, done))

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for page, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.slice(i, 64).columns), strict=True):
                    number += 1
                    for data in records(f"urn:gatefold:{task.partitionId()}-{task.taskAttemptId()}-{number}", page, payload, digest, refers_to):
                        if stream is None or done + len(data) > archive:
                            close()
                            path, count, done = f"{root}/{task.partitionId()}-{task.taskAttemptId()}-{len(out)}.warc.gz", 0, 0
                            stream = system.open_output_stream(path, compression=None)
                        stream.write(data)
                        count, done = count + 1, done + len(data)
        close()
        uri = folder[: len(folder) - len(root)] if folder.endswith(root) else ""
        yield pa.RecordBatch.from_arrays([pa.array([uri + x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["path", "records", "bytes"])

    return scratch.stored(planned(pages, page_id, html).mapInArrow(work, "path string, records long, bytes long"))


def read(archives: DataFrame) -> DataFrame:
    """page, payload_bytes, payload_digest, kind, refers_to of each response and revisit in the archives (path)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RECORD.split(", ")]
        kinds = pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, at = _open(path)
                with system.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in _read(stream):
                        kind, segment = head["warc-type"], head.get("warc-segment-number")
                        page = head.get("warc-target-uri", "").removeprefix("urn:page:") or None
                        refers_to = head.get("warc-refers-to-target-uri", "").removeprefix("urn:page:") or None
                        digest, length = head["warc-payload-digest"].removeprefix("sha256:"), None
                        if kind == "revisit":
                            length = int(next(x for x in block.lower().split(b"\r\n") if x.startswith(b"content-length:"))[15:])
                            block = None
                        elif segment is None:
                            length, block = _checked(block, digest), None
                        total = head.get("warc-segment-total-length")
                        rows.append((head.get("warc-segment-origin-id", head["warc-record-id"]), segment and int(segment), total and int(total), page, kind, refers_to, digest, length, block))
                        size += 300 + len(block or b"")
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                out = []
                for row in batch.slice(i, 64).column(0).to_pylist():
                    row.sort(key=lambda x: x["segment"] or 1)
                    first, last = row[0], row[-1]
                    if first["segment"] is not None:
                        if [x["segment"] for x in row] != list(range(1, len(row) + 1)) or last["total"] is None or sum(len(x["block"]) for x in row) != last["total"]:
                            raise ValueError(f"segments of {first['origin']} are missing")
                        first["length"] = _checked(b"".join(x["block"] for x in row), first["digest"])
                    out.append((first["page"], first["length"], first["digest"], first["kind"], first["refers_to"]))
                kinds = pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = archives.select("path").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), F.xxhash64("path"))
    found = spread.mapInArrow(scan, _RECORD)
    whole = found.groupBy("origin").agg(F.collect_list(F.struct("origin", "segment", "total", "page", "kind", "refers_to", "digest", "length", "block")).alias("parts"))
    return whole.select("parts").mapInArrow(join, "page string, payload_bytes long, payload_digest string, record_type string, refers_to string")


def _checked(block: bytes, digest: str) -> int:
    payload = payload_of(block)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("a payload doesn't match its digest")
    return len(payload)


def archived(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from archives written and read back.

    Null html is an empty payload. Payloads under LEAST bytes are all responses. Of equal ones from there on the smallest
    page_id is the response, and so is every row that repeats that page_id; a page without an id is a revisit if any
    equal page has one, else a response. An empty table gives no rows."""
    kind = pages.schema[page_id].dataType
    found = read(write(pages, page_id, html))
    return found.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
