"""Toxicity: a bag of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and of the word itself, hashed into BUCKETS; a document is the
mean of its words; two linear outputs go through a softmax. A misspelt word shares most n-grams with the word it distorts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatefold.llm import scratch
from gatefold.llm.labelled import adam, held_out, sample, sigmoid
from gatefold.llm.words import Words, mix, pieces

#: Labelled documents that the model is fitted on, at most, and distinct words of these, at most.
MOST_LABELLED, MOST_WORDS = 6_000, 3_000_000
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 8, 3, 5
EPOCHS, RATE, DECAY, SEED = 120, 0.05, 0.3, 7
#: A subword whose count in toxic documents is d deviations from chance moves d ** STEEP / (d ** STEEP + PRIOR ** STEEP) as far as a certain one.
PRIOR, STEEP = 8.0, 6
#: A constant factor of the mean, so that weights of usual size can answer to a few words in a hundred.
GAIN = 50.0
CUT = 0.5
#: Distinct words whose subwords are made or summed at a time in the fit.
BLOCK = 1 << 14


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of <word>, and of the word, one word after the other, and where each word's begin."""
    marked = "".join(["<" + w.decode(errors="replace") + ">" for w in words])
    code = np.frombuffer(marked.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(code == ord(">")) + 1  # no word holds this sign
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    size = ends - starts
    hashes, of = [], []
    number = np.repeat(np.arange(len(words)), size)
    for n in range(SHORTEST, LONGEST + 1):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + code[j : len(code) - n + 1 + j]
        inside = number[: len(h)] == number[n - 1 :]
        hashes.append(h[inside])
        of.append(number[: len(h)][inside])
    whole = np.add.reduceat((code + np.uint64(1)) * (np.uint64(0x9E3779B97F4A7C15) ** (np.arange(len(code)) - np.repeat(starts, size)).astype(np.uint64)), starts) if len(words) else np.zeros(0, np.uint64)
    hashes.append(whole)
    of.append(np.arange(len(words)))
    h, of = np.concatenate(hashes), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return (mix(h[order]) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(of[order], np.arange(len(words)))


def distinct_words(w: Words) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a table of texts, and for each word of it the number among those."""
    _, first, inverse = np.unique(w.hashes, return_index=True, return_inverse=True)
    low = w.low.tobytes()
    return [low[s:e] for s, e in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], inverse


@dataclass
class Model:
    """``gain``: of each bucket, the difference of the two outputs that its vector makes."""

    gain: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        w = Words(texts)
        out = np.full(len(texts), self.bias)
        if len(w):
            words, number = distinct_words(w)
            ids, starts = subwords(words)
            worth = np.add.reduceat(self.gain[ids], starts) / np.diff(np.append(starts, len(ids)))
            sums = np.concatenate(([0.0], np.cumsum(worth[number])))
            out += (sums[w.bounds[1:]] - sums[w.bounds[:-1]]) / np.maximum(1, np.diff(w.bounds))
        return sigmoid(out)


def bag(text: bytes) -> tuple[bytes, np.ndarray]:
    """The distinct words of a text, in the order of their hashes and with blanks between, and how often each occurs."""
    words, number = distinct_words(Words([text]))
    return b" ".join(words), np.bincount(number, minlength=len(words)).astype(np.int32)


def train(texts: list[bytes], labels: np.ndarray) -> Model:
    """The model of whole texts; see ``learnt``."""
    bags = [bag(t) for t in texts]
    return learnt([words for words, _ in bags], np.concatenate([np.zeros(0, np.int32), *(n for _, n in bags)]), labels)


def learnt(bags: list[bytes], counts: np.ndarray, labels: np.ndarray) -> Model:
    """Embeddings and outputs fitted together on documents, each the words of a ``bag``, ``counts`` of all of them one after
    the other; without both labels the model knows only their rate.

    All subwords are given vectors, and no size of the input switches any off. What a few documents hold by chance is kept
    small by a prior that grows with the evidence of a subword's count, and by weight decay.

    The two outputs of a document are linear in its subwords' vectors, and their errors are opposite; so each epoch needs
    one number for each subword, its gain, and one for its gradient.

    Four bytes stay of each subword of a distinct word; the rest is done for BLOCK words at a time, so that a driver holds it."""
    rate = (float(labels.sum()) + 0.5) / (len(labels) + 1)
    bias = np.array([0.0, np.log(rate / (1 - rate))])
    nothing = Model(np.zeros(BUCKETS), float(bias[1] - bias[0]))
    w = Words(bags)
    if not len(w) or labels.min() == labels.max():
        return nothing
    doc = w.text_of(np.arange(len(w))).astype(np.int32)
    _, first, word = np.unique(w.hashes, return_index=True, return_inverse=True)
    low, starts, ends = w.low.tobytes(), w.starts[first], w.ends[first]
    n, word = len(first), word.astype(np.int32)
    del w, first
    size, blocks, seen = np.zeros(n, np.int32), [], np.zeros(BUCKETS, bool)
    for k in range(0, n, BLOCK):
        ids, at = subwords([low[s:e] for s, e in zip(starts[k : k + BLOCK].tolist(), ends[k : k + BLOCK].tolist(), strict=True)])
        size[k : k + BLOCK] = np.diff(np.append(at, len(ids)))
        seen[ids] = True
        blocks.append(ids.astype(np.int32))
    del low, starts, ends
    used, number = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)
    for ids in blocks:
        ids[:] = number[ids]
    share = GAIN * counts / np.bincount(doc, counts, len(bags))[doc] / size[word]
    doc_at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    filled = doc[doc_at]

    def of_words(worth: np.ndarray) -> np.ndarray:
        """For each word the sum of its subwords' ``worth``."""
        out = np.empty(n)
        for k, ids in zip(range(0, n, BLOCK), blocks, strict=True):
            own = size[k : k + BLOCK]
            out[k : k + BLOCK] = np.add.reduceat(worth[ids], np.cumsum(own) - own)
        return out

    def of_subwords(worth: np.ndarray) -> np.ndarray:
        """For each subword the sum of its words' ``worth``."""
        out = np.zeros(len(used))
        for k, ids in zip(range(0, n, BLOCK), blocks, strict=True):
            out += np.bincount(ids, np.repeat(worth[k : k + BLOCK], size[k : k + BLOCK]), len(used))
        return out

    # how often a subword occurs in toxic documents, and how often it would by chance: in how many, for each of its words
    total = of_subwords(np.bincount(word, minlength=n).astype(float))
    found = of_subwords(np.bincount(word, labels[doc], n))
    usual = total * labels[doc].mean()
    odd = (np.abs(found - usual) / np.sqrt(usual + 1)) ** STEEP
    scale = odd / (odd + PRIOR**STEEP)
    rng = np.random.default_rng(SEED)
    table, out = np.zeros((len(used), DIM)), rng.normal(0, 1, (DIM, 2))
    moves = [adam(table.shape, RATE, DECAY), adam(out.shape, RATE), adam(bias.shape, RATE)]
    for _ in range(EPOCHS):
        apart = out[:, 1] - out[:, 0]
        score = np.full(len(bags), bias[1] - bias[0])
        score[filled] += np.add.reduceat(of_words(scale * (table @ apart))[word] * share, doc_at)
        error = (sigmoid(score) - labels) / len(bags)  # the softmax of two outputs
        back = scale * of_subwords(np.bincount(word, error[doc] * share, n))
        turn = table.T @ back
        moves[0](table, back[:, None] * apart)
        moves[1](out, np.stack([-turn, turn], 1))
        moves[2](bias, np.array([-error.sum(), error.sum()]))
    gain = np.zeros(BUCKETS)
    gain[used] = GAIN * scale * (table @ (out[:, 1] - out[:, 0]))
    return Model(gain, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, most_words: int = MOST_WORDS) -> Model:
    """Fits on at most ``most`` labelled documents; whole texts, as their distinct words and counts.

    Of those, in the order of a hash of their texts, the first that have ``most_words`` distinct words together teach; a
    longer one is left out and the next are tried, so that the driver gets bounded bytes whatever the documents are like."""

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                out = [(words, counts.tobytes(), len(counts)) for words, counts in map(bag, texts)]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["doc_id", "label", "words", "counts", "n"])

    rows = sample(docs, labels, label, most)
    bags = scratch.stored(rows.mapInArrow(bagged, T.StructType([rows.schema["doc_id"], T.StructField("label", T.IntegerType()), *T._parse_datatype_string("words binary, counts binary, n long").fields])).withColumn("turn", F.xxhash64("words", "counts", "label")))
    room, chosen = most_words, []
    for r in bags.select("turn", "n", "label").orderBy("turn", "n", "label").limit(most).collect():
        if r.n <= room:
            room -= r.n
            chosen.append((r.turn, r.n, r.label))
    picked = bags.sparkSession.createDataFrame(sorted(set(chosen)) or [(0, -1, 0)], "turn long, n long, label int")
    table = bags.join(F.broadcast(picked), ["turn", "n", "label"], "left_semi").orderBy("turn", "n", "label").limit(len(chosen)).select("label", "words", "counts").toArrow()
    scratch.release(bags)
    if not table.num_rows:
        return Model(np.zeros(BUCKETS), 0.0)
    label, words, counts = table.columns
    return learnt(words.to_pylist(), np.frombuffer(b"".join(counts.to_pylist()), np.int32), np.asarray(label, np.int64))


def scored(docs: DataFrame, model, doc_id: str = "doc_id", text: str = "text", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of each document; the score depends on the text alone.

    Null and empty texts get the model's bias; equal texts, and so repeated rows, equal scores; without labels all scores
    are one half; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", 1 << 19):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "held_out", "score"])

    out = rows.mapInArrow(work, T.StructType([*rows.schema.fields[:2], T.StructField("score", T.DoubleType())]))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accepted(docs: DataFrame, model, text: str = "text", cut: float = CUT, above: bool = False) -> DataFrame:
    """The documents that score under ``cut`` (above: at least ``cut``), with their columns, whatever these are called.

    Null and empty texts have the model's bias as their score; equal texts stay or go together; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(docs.columns))]  # names may clash but in case
    place = names[docs.columns.index(text)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, place, 1 << 19):
                yield part.filter(pa.array((shared.value.score(texts) >= cut) == above))

    rows = docs.toDF(*names)
    return rows.mapInArrow(work, rows.schema).toDF(*docs.columns)
