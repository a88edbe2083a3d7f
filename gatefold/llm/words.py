"""Words of whole UTF-8 texts as numpy arrays: bounds, 64-bit hashes, shingles. A word is a run of bytes that are
digits, ASCII letters (A-Z lower-cased) or parts of non-ASCII characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_IS_LETTER = _IS_WORD.copy()
_IS_LETTER[48:58] = False
#: 0 white space and controls, 1 signs, 2 letters and digits.
_KIND = np.where(_IS_WORD, 2, np.where((np.arange(256) <= 32) | (np.arange(256) == 127), 0, 1)).astype(np.uint8)
#: Odd multipliers of the hashes.
_BASE, _MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes that are hashed at a time.
WINDOW = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> list[np.ndarray]:
    """Powers of _BASE and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = pow(int(_BASE), -1, 1 << 64)
        for k, x in enumerate((int(_BASE), inverse)):
            steps = np.full(n, x, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Words:
    """``bounds[d]:bounds[d+1]`` are the words of text d; ``starts``, ``ends`` are byte positions in ``low``. symbols:
    letters keep their case, and runs of signs are words too. digits: they are parts of words."""

    def __init__(self, texts: list[bytes], hashed: bool = True, symbols: bool = False, digits: bool = True):
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.low = buf if symbols else _LOWER[buf]
        mask = _KIND[buf] if symbols else (_IS_WORD if digits else _IS_LETTER)[buf]
        edge = np.flatnonzero(mask[1:] != mask[:-1]) + 1
        if symbols:
            edge = np.concatenate(([0], edge, [len(buf)]))
            real = mask[edge[:-1]] > 0
            self.starts, self.ends = edge[:-1][real], edge[1:][real]
        else:
            if len(mask) and mask[0]:
                edge = np.concatenate(([0], edge))
            self.starts, self.ends = edge[::2], edge[1::2]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=at[1:])
        self.text_at = at
        self.bounds = np.searchsorted(self.starts, at)
        if hashed:
            self.hashes = self._hash()

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self) -> np.ndarray:
        out, i, n = np.empty(len(self), np.uint64), 0, len(self)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + WINDOW)))
            lo, hi = self.starts[i], self.ends[j - 1]
            power, inverse = _tables(int(hi - lo) + 1)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((self.low[lo:hi].astype(np.uint64) + np.uint64(1)) * power[: hi - lo], out=sums[1:])
            s, e = self.starts[i:j] - lo, self.ends[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * inverse[s]
            i = j
        return mix(out)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and whether they lie in one text."""
        h, n = self.hashes, len(self)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = h[: n - k + 1].copy()
        for j in range(1, k):
            out *= _STEP
            out += h[j : n - k + 1 + j]
        inside = np.ones(n - k + 1, bool)
        for j in range(1, k):  # a shingle that starts among the last k-1 words of a text leaves it
            at = self.bounds[1:-1] - j
            inside[at[(at >= 0) & (at < len(inside))]] = False
        return mix(out), inside

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text in which each word of ``at`` lies."""
        return np.searchsorted(self.bounds, at, "right") - 1

    def compact(self) -> tuple[bytes, np.ndarray]:
        """All words, each followed by one blank, and where each begins."""
        lengths = self.ends - self.starts + 1
        at = np.zeros(len(self) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        keep = np.zeros(len(self.low) + 1, np.int8)
        keep[self.starts] += 1
        keep[self.ends + 1] -= 1
        out = self.low[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
        if len(out):
            out[at[1:] - 1] = 32
        return out.tobytes(), at


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, text: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with at most so many bytes of text, or one row, and their texts."""
    texts = as_bytes(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < len(texts):
        j, size = i + 1, len(texts[i])
        while j < len(texts) and size + len(texts[j]) <= most:
            size += len(texts[j])
            j += 1
        yield batch.slice(i, j - i), texts[i:j]
        i = j
