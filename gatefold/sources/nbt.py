"""Named binary tags, as far as schematics use them, both ways.

To write, a value is a pair of its tag and its content: a dict of pairs for a compound, (tag, contents) for a list. Read
values are plain: dicts, lists, ints, bytes, text, and numpy arrays of ints.
"""

from __future__ import annotations

import gzip
import struct

import numpy as np

#: Tag numbers of the format.
BYTE, SHORT, INT, LONG, FLOAT, DOUBLE, BYTES, STRING, LIST, COMPOUND, INTS, LONGS = range(1, 13)

_NUMBER = {BYTE: ">b", SHORT: ">h", INT: ">i", LONG: ">q", FLOAT: ">f", DOUBLE: ">d"}
_ARRAY = {BYTES: "i1", INTS: ">i4", LONGS: ">i8"}


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">H", len(raw)) + raw


def _body(tag: int, value) -> bytes:
    if tag in _NUMBER:
        return struct.pack(_NUMBER[tag], value)
    if tag == STRING:
        return _text(value)
    if tag in _ARRAY:
        raw = bytes(value) if tag == BYTES else np.asarray(value, _ARRAY[tag]).tobytes()
        return struct.pack(">i", len(value)) + raw
    if tag == LIST:
        kind, items = value
        return struct.pack(">bi", kind, len(items)) + b"".join(_body(kind, x) for x in items)
    return b"".join(bytes([kind]) + _text(name) + _body(kind, x) for name, (kind, x) in value.items()) + b"\0"


def encode(root: dict, name: str) -> bytes:
    """A gzipped file of one compound; equal input gives equal bytes."""
    return gzip.compress(bytes([COMPOUND]) + _text(name) + _body(COMPOUND, root), mtime=0)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, form: str):
        n = struct.calcsize(form)
        if self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return struct.unpack_from(form, self.data, self.at - n)[0]

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        return self.raw(self.number(">H")).decode()

    def value(self, tag: int):
        if tag in _NUMBER:
            return self.number(_NUMBER[tag])
        if tag == STRING:
            return self.text()
        if tag in _ARRAY:
            n, kind = self.number(">i"), np.dtype(_ARRAY[tag])
            raw = self.raw(n * kind.itemsize)
            return raw if tag == BYTES else np.frombuffer(raw, kind).astype(np.int64)
        if tag == LIST:
            kind, n = self.number(">b"), self.number(">i")
            return [self.value(kind) for _ in range(n)]
        if tag == COMPOUND:
            out = {}
            while kind := self.number(">b"):
                name = self.text()
                if name in out:
                    raise ValueError(f"{name} stands twice in a compound")
                out[name] = self.value(kind)
            return out
        raise ValueError(f"there is no tag {tag}")


def decode(blob: bytes) -> dict:
    """The compound of a gzipped file; anything else raises ValueError."""
    try:
        r = _Reader(gzip.decompress(blob))
    except (OSError, EOFError) as e:
        raise ValueError("no gzipped file") from e
    if r.number(">b") != COMPOUND:
        raise ValueError("the root is no compound")
    r.text()
    return r.value(COMPOUND)
