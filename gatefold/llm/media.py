"""Media columns: payloads as baseline JPEGs, read back by marker parsing and Huffman decoding in numpy.

The encoder stores one byte as the DC coefficient of one 8x8 block of a greyscale image, quantiser 8, all other
coefficients zero: a block's mean is exactly the byte, so a DC-only thumbnail of the image is the payload. Its Huffman
codes are chosen so that each block takes 16 bits. The decoder reads any baseline, Huffman-coded JPEG: where a scan's
tables give all blocks one length it decodes them at once, otherwise it walks the bits.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch
from gatefold.llm.words import pieces

#: Payloads are padded with zeros to a positive multiple of this; also the width of an image in blocks.
UNIT = 64
#: Rows of blocks in one image; a longer payload takes several images, one after the other.
ROWS = 8191
SIDE = 8

#: Lengths of the encoder's DC codes by category 0..8, such that code, extra bits and the one-bit end of block make 16.
_DC_BITS = tuple(15 - c for c in range(9))


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, bits), as a DHT segment defines them."""
    out, code, last = {}, 0, 0
    for bits, symbol in sorted((b, s) for s, b in lengths.items()):
        code <<= bits - last
        out[symbol], last = (code, bits), bits
        code += 1
    return out


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    return bytes([kind]) + bytes(sum(lengths[s] == b for s in lengths) for b in range(1, 17)) + bytes(order)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _words() -> np.ndarray:
    """The 16 bits of a block by difference + 255."""
    codes = _canonical(dict(enumerate(_DC_BITS)))
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        out[d + 255] = ((codes[c][0] << c) | extra) << 1  # the end of block is the bit 0
    return out


_WORD = _words()
_HEAD = b"\xff\xd8" + _segment(0xDB, bytes([0, 8]) + b"\x01" * 63)
_TABLES = _segment(0xC4, _dht(0x00, dict(enumerate(_DC_BITS))) + _dht(0x10, {0: 1}))
_SCAN = _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode(payload: bytes) -> bytes:
    """JPEGs, one after the other, that hold the payload, whose length is a positive multiple of UNIT."""
    out = []
    for i in range(0, len(payload), UNIT * ROWS):
        part = np.frombuffer(payload, np.uint8, min(UNIT * ROWS, len(payload) - i), i).astype(np.int16)
        steps = np.empty(len(part), np.int16)
        steps[0] = part[0] - 128
        np.subtract(part[1:], part[:-1], out=steps[1:])
        frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, len(part) // UNIT * SIDE, UNIT * SIDE, 1, 1, 0x11, 0))
        body = _WORD[steps + 255].astype(">u2").tobytes()
        out += [_HEAD, frame, _TABLES, _SCAN, body.replace(b"\xff", b"\xff\x00"), b"\xff\xd9"]
    return b"".join(out)


_BROKEN = np.iinfo(np.int32).min


@functools.lru_cache(64)
def _block_table(dc: tuple, ac: tuple) -> tuple[int, np.ndarray | None]:
    """Bits of a block that ends behind its DC value, and the difference that each such word codes; 0 if blocks differ in length."""
    bits = {b + s for s, b in dc}
    if len(ac) != 1 or ac[0][0] != 0 or len(bits) != 1:
        return 0, None
    each = bits.pop() + ac[0][1]
    if each not in (8, 16):
        return 0, None
    table = np.full(1 << each, _BROKEN, np.int32)
    end = _canonical(dict(ac))[0]
    for c, (code, _) in _canonical(dict(dc)).items():
        extra = np.arange(1 << c)
        table[(((code << c) | extra) << end[1]) | end[0]] = np.where(extra >> max(c - 1, 0), extra, extra - (1 << c) + 1) if c else 0
    return each, table


class Jpeg:
    """Markers of one baseline image: ``width``, ``height``, ``components`` (id, h, v, quantiser), tables, scan bytes."""

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        self.quant: dict[int, int] = {}
        self.huffman: dict[int, dict[int, int]] = {}
        self.restart = 0
        while True:
            if data[at] != 0xFF:
                raise ValueError(f"no marker at {at}")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            (size,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    self.quant[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                    i += 1 + 64 * (1 + wide)
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    counts = body[i + 1 : i + 17]
                    symbols = iter(body[i + 17 : i + 17 + sum(counts)])
                    self.huffman[body[i]] = {next(symbols): b + 1 for b, n in enumerate(counts) for _ in range(n)}
                    i += 17 + sum(counts)
            elif marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if depth != 8:
                    raise ValueError("not 8 bits a sample")
                self.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
                raise ValueError("not baseline")
            elif marker == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif marker == 0xDA:
                self.selected = {body[1 + 2 * k]: body[2 + 2 * k] for k in range(body[0])}
                break
        end = at
        while True:
            end = data.index(b"\xff", end)
            if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                end += 2
            else:
                break
        self.scan, self.end = data[at:end], end + 2 if data[end + 1] == 0xD9 else end

    def luminance(self) -> np.ndarray:
        """A sample for each 8x8 block of the first component: its mean, from the DC coefficient alone."""
        own, h, v, q = self.components[0]
        if len(self.components) == 1:
            h = v = 1
        across = -(-self.width // (8 * (max(x[1] for x in self.components) if len(self.components) > 1 else 1)))
        down = -(-self.height // (8 * (max(x[2] for x in self.components) if len(self.components) > 1 else 1)))
        dc = self._fixed(across * down) if len(self.components) == 1 and not self.restart else None
        if dc is None:
            dc = self._walk(across * down)
        grid = np.asarray(dc).reshape(down, across, v, h).swapaxes(1, 2).reshape(down * v, across * h)
        wide = grid[: -(-self.height // 8) if len(self.components) == 1 else None]
        return np.clip(np.round(wide * self.quant[q] / 8) + 128, 0, 255).astype(np.uint8)

    def _fixed(self, blocks: int) -> np.ndarray | None:
        """Quantised DC values if by the tables every block of a DC-only scan takes one and the same number of bits, 8 or 16."""
        pair = self.selected[self.components[0][0]]
        each, table = _block_table(tuple(self.huffman[pair >> 4].items()), tuple(self.huffman[0x10 | pair & 15].items()))
        if not each:
            return None
        scan = self.scan.replace(b"\xff\x00", b"\xff")
        words = np.frombuffer(scan, ">u2" if each == 16 else np.uint8)[:blocks]
        steps = table[words]
        if len(words) < blocks or steps.min(initial=0) == _BROKEN:
            raise ValueError("broken scan")
        return np.cumsum(steps, dtype=np.int32)

    def _walk(self, units: int) -> list[int]:
        """DC values of the first component, bit by bit, for any tables, components and restart intervals."""
        tables = {}
        for k, lengths in self.huffman.items():
            tables[k] = {(bits, code): s for s, (code, bits) in _canonical(lengths).items()}
        out: list[int] = []
        parts = [self.scan]
        if self.restart:
            parts, i, last = [], 0, 0
            while (i := self.scan.find(b"\xff", i)) >= 0:
                if 0xD0 <= self.scan[i + 1] <= 0xD7:
                    parts.append(self.scan[last:i])
                    last = i + 2
                i += 2
            parts.append(self.scan[last:])
        left = units
        for part in parts:
            data = part.replace(b"\xff\x00", b"\xff")
            bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
            at = 0

            def symbol(table: dict) -> int:
                nonlocal at
                code = 0
                for n in range(1, 17):
                    code = code << 1 | bits[at]
                    at += 1
                    if (n, code) in table:
                        return table[n, code]
                raise ValueError("broken code")

            def extra(n: int) -> int:
                nonlocal at
                x = 0
                for b in bits[at : at + n]:
                    x = x << 1 | b
                at += n
                return x if not n or x >> (n - 1) else x - (1 << n) + 1

            before = [0] * len(self.components)
            for _ in range(min(left, self.restart or left)):
                for k, (own, h, v, _q) in enumerate(self.components):
                    pair = self.selected[own]
                    for _ in range(h * v if len(self.components) > 1 else 1):
                        before[k] += extra(symbol(tables[pair >> 4]))
                        if not k:
                            out.append(before[0])
                        i = 1
                        while i < 64:
                            s = symbol(tables[0x10 | pair & 15])
                            if s == 0:
                                break
                            i += (s >> 4) + 1
                            at += s & 15
            left -= min(left, self.restart or left)
        return out


def images(media: bytes) -> list[Jpeg]:
    out, at = [], 0
    while at < len(media):
        out.append(Jpeg(media, at))
        at = out[-1].end
    return out


def _shrunk(thumb: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area means on a grid of rows x columns; rows or columns of small images are repeated."""
    r = np.linspace(0, thumb.shape[0], rows + 1).astype(np.int64)
    c = np.linspace(0, thumb.shape[1], columns + 1).astype(np.int64)
    r1, c1 = np.maximum(r[1:], r[:-1] + 1), np.maximum(c[1:], c[:-1] + 1)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumb, 0, dtype=np.int64), 1, out=sums[1:, 1:])
    total = sums[r1][:, c1] - sums[r[:-1]][:, c1] - sums[r1][:, c[:-1]] + sums[r[:-1]][:, c[:-1]]
    return total / np.outer(r1 - r[:-1], c1 - c[:-1])


def feature(pictures: list[Jpeg], thumb: np.ndarray) -> str:
    """Width, height and images; average hash and difference hash of the thumbnail, 64 bits each."""
    small = _shrunk(thumb, 8, 9)
    mean = np.packbits(small[:, :8] > small[:, :8].mean()).tobytes().hex()
    step = np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()
    return f"{pictures[0].width}x{sum(p.height for p in pictures)}/{len(pictures)}:{mean}:{step}"


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media of each document."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                media = [encode(x + b"\0" * (max(UNIT, -(-len(x) // UNIT) * UNIT) - len(x))) for x in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(work, T.StructType([rows.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def from_media(table: DataFrame) -> DataFrame:
    """What the stored images give when they are parsed and decoded, beside doc_id and n_bytes."""
    names = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out: list[list] = [[] for _ in names]
                for media in part.column(2).to_pylist():
                    pictures = images(media)
                    thumb = np.concatenate([p.luminance() for p in pictures])
                    payload = thumb.tobytes()
                    values = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(pictures, thumb)
                    for column, x in zip(out, values, strict=True):
                        column.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, out, names.values())], ["doc_id", "n_bytes", *names])

    kinds = {pa.int64(): T.LongType(), pa.string(): T.StringType()}
    return table.mapInArrow(work, T.StructType([*table.schema.fields[:2], *(T.StructField(n, kinds[k]) for n, k in names.items())]))


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the features of each document's image, which is written to a table and read back.

    Null and empty texts give 64 zero bytes; equal texts, and so repeated rows, equal values; an empty table gives no rows.
    Texts over UNIT*ROWS bytes take several images."""
    return from_media(scratch.stored(to_media(docs, doc_id, text)))
