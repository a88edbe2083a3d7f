"""Token ids of whole texts, equal to those of the ``tokenizers`` library for a byte-level BPE vocabulary file.

A text falls into pieces at each blank between two characters that are no white space; the vocabulary's pattern never
reaches across such a place, so pieces are encoded alone and remembered. All new pieces of a batch are encoded in one call
by the merge loop of ``tiktoken`` over the ranks of the same file; the file is checked to have ids in the order of merges.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k.json"
#: Bytes, about, of the pieces that a worker remembers; beyond these it starts anew.
MOST_BYTES = 48 << 20

_cut = re.compile(r"(?<=\S) (?=\S)")
#: White space besides the blank; a text that has some beside a blank, or two blanks together, is cut with care.
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]
_NEAR = ["  ", *(x for c in _SPACES if ord(c) < 128 for x in (f" {c}", f"{c} "))]


def _odd(text: str) -> bool:
    return text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _NEAR) or not text.isascii() and any(c in text for c in _SPACES[9:])


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write each byte as a printable letter: itself if it is one, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token and its id, which is also the order of its merge."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    if file["normalizer"] is not None or model["type"] != "BPE" or file["pre_tokenizer"]["type"] != "ByteLevel" or file["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    special = {x["content"] for x in file["added_tokens"]}
    out = {bytes(byte_of[c] for c in token): k for token, k in model["vocab"].items() if token not in special}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made):
        raise ValueError(f"{path} has ids that don't follow its merges")
    return out


def added(path: str) -> dict[str, int]:
    """The strings of added tokens and their ids. They are found in a text as they stand, before all else."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(x[k] for x in tokens for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError(f"{path} has added tokens that aren't found as they stand")
    return {x["content"]: x["id"] for x in tokens}


class Encoder:
    def __init__(self, path: str):
        self.core = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=(table := ranks(path)), special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        self.size[list(table.values())] = [len(t) for t in table]
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.added = {k: np.array([v], "<u4").tobytes() for k, v in added(path).items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), "<u4")

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers; the string of an added token is that token."""
        special = [k for k, t in enumerate(texts) if self.parts and any(s in t for s in self.added)]
        if not special:
            return self._plain(texts)
        parts = [self.parts.split(t) if k in set(special) else [t] for k, t in enumerate(texts)]
        plain = iter(self._plain([x for own in parts for x in own[::2]]))
        return [b"".join([self.added[x] if k % 2 else next(plain) for k, x in enumerate(own)]) for own in parts]

    def _plain(self, texts: list[str]) -> list[bytes]:
        if self.held > MOST_BYTES:
            self.known.clear()
            self.held = 0
        split = [_cut.split(t) if _odd(t) else t.split(" ") for t in texts]
        new = list({p for pieces in split for p in pieces[1:]}.difference(self.known))
        ids = self._ids("".join([" " + p for p in new]))
        ends = np.cumsum([len(p.encode()) + 1 for p in new])
        cuts = [0, *(4 * np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 4).tolist()]
        blob, known = ids.tobytes(), self.known
        self.held += 2 * sum(map(len, new)) + len(blob) + 200 * len(new)
        known.update(zip(new, [blob[a:b] for a, b in zip(cuts, cuts[1:])], strict=False))
        return [self._ids(pieces[0]).tobytes() + b"".join([known[p] for p in pieces[1:]]) for pieces in split]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    return Encoder(path)
