"""Source divergence audit: how far each source of a language lies from its other sources and from the language as a whole.

Counts of (lang, source, term) are summed by Spark; those of a kept term become one row of a term-major index, its sources
and their counts. The table of all pairs of sources is then the product of the group-major and the term-major form, row by
row after Gustavson: a group scatters its terms through the index into one dense accumulator over its peers, so no pair of
postings is ever a row. Absent terms have a probability too. What a pair would have if no term were shared, from
histograms of each group's counts, and what it would have if all counts were zero, is added for all peers at once, so
that only the entries of shared terms correct it. Each task does so for its terms; Spark sums the accumulators.

Bounds: a term's row has a cell for each source of its language, and the sources' totals are broadcast. The result has a
row for each ordered pair of sources of a language, so both are about the square root of what is to be written.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatefold.llm import scratch
from gatefold.llm.words import Words, pieces

#: Documents of its language that a kept term is in; ranks of terms that are returned.
LEAST, TERMS = 3, 200
#: Terms that a task takes at a time; cells of accumulators that it holds.
CHUNK, CELLS = 20_000, 4 << 20
SCALE = 1_000_000_000


def probability(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact for totals up to 9e15: a long division, three digits at a time."""
    rest, out = np.broadcast_arrays(np.asarray(count, np.int64) + 1, np.asarray(total, np.int64))[0].copy(), np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), summed over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, "text", 8 << 20):
                w = Words(texts, digits=False)
                if not len(w):
                    continue
                _, first, term = np.unique(w.hashes, return_index=True, return_inverse=True)
                terms = pa.array([w.low[a:b].tobytes() for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
                groups = pa.StructArray.from_arrays([part.column(0), part.column(1)], ["lang", "source"])
                places: dict[tuple, int] = {}
                group = np.array([places.setdefault((x["lang"], x["source"]), len(places)) for x in groups.to_pylist()], np.int64)
                key, n = np.unique(term * len(texts) + np.repeat(np.arange(len(texts)), np.diff(w.bounds)), return_counts=True)
                cell, at = np.unique(key // len(texts) * len(places) + group[key % len(texts)], return_inverse=True)
                names = list(places)
                of = pa.array(cell % len(places))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.string()).take(of), pa.array([x for _, x in names], pa.string()).take(of), terms.take(pa.array(cell // len(places))), pa.array(np.bincount(at, n).astype(np.int64)), pa.array(np.bincount(at))], ["lang", "source", "term", "n", "docs"])

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source"), (text, "text"))))
    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_index(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """A row for each kept term of a language: lang, term, postings (source, n), written to the shared folder."""
    grouped = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return scratch.stored(grouped.filter(F.col("docs") >= least).select("lang", "term", "postings"))


@dataclass
class Language:
    """Its sources in order, the denominator of each and of all."""

    sources: list[str]
    total: np.ndarray
    whole: int
    kept: int

    def __post_init__(self) -> None:
        self.place = {s: k for k, s in enumerate(self.sources)}
        self.zero = probability(0, np.maximum(self.total, 1))


def languages(docs: DataFrame, index: DataFrame, lang: str = "lang", source: str = "source") -> dict[str, Language]:
    """Every (lang, source) that occurs, with totals over kept terms."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source")))).distinct()
    sums = index.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = {r.lang: r.kept for r in index.groupBy("lang").agg(F.count(F.lit(1)).alias("kept")).collect()}
    by_lang: dict[str, list[tuple[str, int]]] = {}
    for r in groups.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n")).collect():
        by_lang.setdefault(r.lang, []).append((r.source, r.n))
    out = {}
    for name, rows in by_lang.items():
        v = kept.get(name, 0)
        rows.sort(key=lambda x: x[0].encode())
        out[name] = Language([s for s, _ in rows], np.array([n + v for _, n in rows], np.int64), sum(n for _, n in rows) + v, v)
    return out


class _Sums:
    """Dense accumulators, a row of peers for each group, and each group's foremost terms."""

    def __init__(self, langs: dict[str, Language], terms: int):
        self.langs, self.terms, self.rows, self.cells, self.top = langs, terms, {}, 0, {}

    def row(self, lang: str, g: int) -> np.ndarray:
        if (lang, g) not in self.rows:
            self.rows[lang, g] = np.zeros(len(self.langs[lang].sources), np.int64)
            self.cells += len(self.rows[lang, g])
        return self.rows[lang, g]

    def add(self, lang: str, terms: list[str], starts: np.ndarray, group: np.ndarray, n: np.ndarray) -> None:
        """Terms of one language; those of term t are the cells starts[t] to starts[t+1] of ``group`` and ``n``."""
        x = self.langs[lang]
        size = np.diff(starts)
        term = np.repeat(np.arange(len(terms)), size)
        p = probability(n, x.total[group])
        q = probability(np.add.reduceat(n, starts[:-1]), x.whole)[term]
        by_group = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[by_group], np.arange(len(x.sources) + 1))
        for h in np.flatnonzero(np.diff(cuts)).tolist():  # as if no term were shared
            own, many = np.unique(p[by_group[cuts[h] : cuts[h + 1]]], return_counts=True)
            zero = distance(x.zero, x.zero[h])
            column = np.array([int((distance(z, own) * many).sum()) for z in x.zero]) - zero * many.sum()
            for g, value in enumerate(column.tolist()):
                self.row(lang, g)[h] += value
            line = self.row(lang, h)
            zero = distance(x.zero[h], x.zero)
            for at in range(0, len(x.sources), 256):
                peers = slice(at, at + 256)
                line[peers] += (distance(own[:, None], x.zero[None, peers]) * many[:, None]).sum(0)
            line -= zero * many.sum()
        for g in np.flatnonzero(np.diff(cuts)).tolist():  # the shared terms' own values instead
            mine = by_group[cuts[g] : cuts[g + 1]]
            for block in np.array_split(mine, max(1, len(mine) * len(x.sources) // (1 << 20))):
                each = size[term[block]]
                cell = np.repeat(starts[term[block]] - np.concatenate(([0], np.cumsum(each)[:-1])), each) + np.arange(each.sum())
                peer, own = group[cell], np.repeat(p[block], each)
                z = x.zero[peer]
                value = distance(own, p[cell]) - distance(own, z) - distance(x.zero[g], p[cell]) + distance(x.zero[g], z)
                np.add.at(self.row(lang, g), peer, value)
            above = mine[p[mine] > q[mine]]
            self.note(lang, g, distance(p[above], q[above]), [terms[t] for t in term[above].tolist()])

    def note(self, lang: str, g: int, value: np.ndarray, terms: list[str]) -> None:
        rows = self.top.setdefault((lang, g), [])
        rows += [(-v, t.encode()) for v, t in zip(value.tolist(), terms, strict=True)]
        if len(rows) > self.terms:
            rows[:] = heapq.nsmallest(self.terms, rows)

    def full(self) -> bool:
        return self.cells > CELLS or 100 * sum(map(len, self.top.values())) > 8 * CELLS

    def batches(self) -> Iterator[pa.RecordBatch]:
        out = []
        for (lang, g), values in self.rows.items():
            names = self.langs[lang].sources
            out += [(lang, names[g], "pair", names[h], int(v)) for h, v in enumerate(values) if h != g and v]
            if len(out) > 1 << 15:
                yield _rows(out)
                out = []
        for (lang, g), rows in self.top.items():
            out += [(lang, self.langs[lang].sources[g], "term", t.decode(), -v) for v, t in rows]
            if len(out) > 1 << 15:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)
        self.rows, self.cells, self.top = {}, 0, {}


_SHAPE = "lang string, source string, part string, item string, value long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["lang", "source", "part", "item", "value"])


def _accumulate(batches: Iterator[pa.RecordBatch], shared, terms: int) -> Iterator[pa.RecordBatch]:
    sums = _Sums(shared.value, terms)
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for lang in dict.fromkeys(names):
            mine = pa.array(np.flatnonzero(names == lang))
            place = shared.value[lang].place
            for at in range(0, len(mine), CHUNK):
                own = mine[at : at + CHUNK]
                lists = batch.column(2).take(own)
                cells = lists.flatten()
                group = np.array([place[s] for s in cells.field("source").to_pylist()], np.int64)
                sums.add(lang, batch.column(1).take(own).to_pylist(), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), np.int64)))), group, np.asarray(cells.field("n")))
                if sums.full():
                    yield from sums.batches()
    yield from sums.batches()


def _baseline(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Each group's peers with what they would have if all counts were zero."""
    for batch in batches:
        for lang, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = shared.value[lang]
            g = x.place[source]
            for at in range(0, len(x.sources), 1 << 15):
                value = x.kept * distance(x.zero[g], x.zero[at : at + (1 << 15)]) if x.kept else np.zeros(len(x.sources[at : at + (1 << 15)]), np.int64)
                rows = [(lang, source, "pair", h, int(v)) for h, v in zip(x.sources[at : at + (1 << 15)], value, strict=True) if h != source]
                if rows:
                    yield _rows(rows)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: each other source of the language and the summed distance from it
    over kept terms. Part ``term``: the group's foremost ``terms`` terms that are likelier in it than in the language.

    Null text, language and source are empty strings. Repeated rows count each time. A group without terms, or a language
    without kept ones, has its pairs. Ties are in the order of their UTF-8 bytes. An empty table has an empty result."""
    scratch.lean(docs.sparkSession)
    index = term_index(term_counts(docs, text, lang, source), least)
    known = languages(docs, index, lang, source)
    shared = docs.sparkSession.sparkContext.broadcast(known)
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(x) for c, x in ((lang, "lang"), (source, "source")))).distinct()
    found = index.mapInArrow(lambda batches: _accumulate(batches, shared, terms), _SHAPE).unionByName(groups.mapInArrow(lambda batches: _baseline(batches, shared), _SHAPE))
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return summed.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= terms))
