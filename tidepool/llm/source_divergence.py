"""Source divergence: which terms set a source apart from its language, and how far the sources of a language lie apart.

Every task counts the terms of its documents in a radix trie of bytes for each language, whose leaves hold the number of
documents and the count of each source. Tries are cut into subtries by the first bytes of their terms; the subtries of a
range of prefixes meet in a task, which merges those of a prefix and walks the result in the order of UTF-8. That walk
yields cells of kept terms. A second walk over the cells, once totals are known, sums up all pairs of sources and keeps
the best candidates of each source; equal values stay in the order of the walk.

Null texts, languages and sources count as empty. Rows are counted as they are: repeated rows and ids count each time,
and ids are never read. An empty table gives nothing. Other columns are not read. A text is held whole by a task, with
about 60 bytes for each of its words; so are the subtries of one prefix while they are merged, and the sources of one
language, as every pair of them is part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.runtime import discard, prepare, stored
from tidepool.llm.textbuf import LOWER, Words, release, slices, text_buffers

UNIT = 1_000_000_000

NO_TERM = np.zeros(256, bool)
NO_TERM[:128] = True
NO_TERM[65:91] = NO_TERM[97:123] = False


@dataclass(frozen=True)
class Settings:
    """A term is kept from ``least`` documents of a language on; ``top`` terms of a source are told.

    Tries are cut by the first ``prefix`` bytes; ``text_bytes`` of text are counted at a time, a cell holds up to ``cell``
    terms, and there is a task of the second walk for each ``share`` terms of all and each language.
    """

    least: int = 3
    top: int = 200
    prefix: int = 6
    text_bytes: int = 8 << 20
    cell: int = 4096
    share: int = 65_536


_SUBTRIE = "lang string, prefix binary, suffixes array<binary>, documents array<long>, widths array<int>, sources array<string>, counts array<long>"
_CELL = "lang string, terms array<binary>, widths array<int>, sources array<string>, counts array<long>, totals map<string, long>, n_terms long"


def grouped(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys, ascending, and the sums of each weight over their rows; without a weight, the number of rows."""
    if not weights:
        keys = np.sort(keys)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
        return keys[at], np.diff(np.r_[at, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], *(np.add.reduceat(w[order], at) if len(at) else w[:0] for w in weights)


def ranked(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value its place among the different values in the order of their bytes, and those values."""
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    return place[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.empty(0, np.int64), coded.dictionary.take(order)



class Trie:
    """A radix trie of bytes, held flat: its leaves as a walk in byte order meets them.

    A leaf is a term with its number of ``documents`` and ``widths`` of its entries in ``source`` and ``count``. The path
    to a leaf forks from the one before it where their terms begin to differ; no other node is kept.
    """

    def __init__(self, terms: pa.Array, documents: np.ndarray, widths: np.ndarray, names: pa.Array, source: np.ndarray, count: np.ndarray):
        self.terms, self.documents, self.widths, self.names, self.source, self.count = terms, documents, widths, names, source, count

    @staticmethod
    def merged(terms: pa.Array, documents: np.ndarray, widths: np.ndarray, names: pa.Array, source: np.ndarray, count: np.ndarray) -> Trie:
        """The trie of leaves in any order: leaves of one term become one, with the sums of what they hold."""
        leaf, different = ranked(terms)
        _, documents = grouped(leaf, documents)
        key, count = grouped(np.repeat(leaf, widths) * len(names) + source, count)
        return Trie(different, documents, np.bincount(key // max(1, len(names)), minlength=len(different)), names, key % max(1, len(names)), count)

    def part(self, a: int, b: int) -> Trie:
        """The leaves from a to b."""
        first = np.r_[0, np.cumsum(self.widths)]
        x, y = first[a], first[b]
        return Trie(self.terms.slice(a, b - a), self.documents[a:b], self.widths[a:b], self.names, self.source[x:y], self.count[x:y])

    def kept(self, least: int) -> Trie:
        """The trie without terms of fewer documents."""
        keep = self.documents >= least
        entries = np.repeat(keep, self.widths)
        return Trie(self.terms.filter(pa.array(keep)), self.documents[keep], self.widths[keep], self.names, self.source[entries], self.count[entries])

    def subtries(self, depth: int) -> np.ndarray:
        """Where the path forks within the first ``depth`` bytes: starts of the subtries below them, and the end."""
        head = pc.binary_slice(self.terms, 0, depth)
        forks = pc.not_equal(head.slice(1), head.slice(0, max(0, len(head) - 1))).to_numpy(zero_copy_only=False)
        return np.r_[0, np.flatnonzero(forks) + 1, len(head)] if len(head) else np.zeros(1, np.int64)

    def lists(self, cuts: np.ndarray) -> list[pa.Array]:
        """widths, sources and counts in lists between the leaves of ``cuts``."""
        outer, inner = pa.array(cuts.astype(np.int32)), pa.array(np.r_[0, np.cumsum(self.widths)][cuts].astype(np.int32))
        sources = self.names.take(pa.array(self.source))
        return [pa.ListArray.from_arrays(outer, pa.array(self.widths.astype(np.int32))), pa.ListArray.from_arrays(inner, sources), pa.ListArray.from_arrays(inner, pa.array(self.count))]

    def rows(self, lang: str, depth: int) -> pa.RecordBatch:
        """The subtries as rows."""
        cuts = self.subtries(depth)
        outer = pa.array(cuts.astype(np.int32))
        prefix = pc.binary_slice(self.terms.take(pa.array(cuts[:-1])), 0, depth)
        suffixes = pa.ListArray.from_arrays(outer, pc.binary_replace_slice(self.terms, 0, depth, b""))
        widths, sources, counts = self.lists(cuts)
        documents = pa.ListArray.from_arrays(outer, pa.array(self.documents))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(prefix)), prefix, suffixes, documents, widths, sources, counts], [x.split()[0] for x in _SUBTRIE.split(", ")])

    def cell(self, lang: str) -> pa.RecordBatch:
        """All leaves as one row, with the sums by source."""
        cuts = np.array([0, len(self.terms)])
        source, total = grouped(self.source, self.count)
        totals = pa.array([list(zip(self.names.take(pa.array(source)).to_pylist(), total.tolist(), strict=True))], pa.map_(pa.string(), pa.int64()))
        terms = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), self.terms)
        return pa.RecordBatch.from_arrays([pa.array([lang]), terms, *self.lists(cuts), totals, pa.array([len(self.terms)])], ["lang", "terms", "widths", "sources", "counts", "totals", "n_terms"])


def counted(batch: pa.RecordBatch) -> Iterator[tuple[str, Trie]]:
    """The trie of each language of a batch of documents."""
    data, offsets = text_buffers(batch.column("text"))
    words = Words(LOWER[data], offsets, NO_TERM)
    if not len(words.starts):
        return
    ends = np.r_[0, np.cumsum(words.ends - words.starts)].astype(np.int32)
    term, terms = ranked(pa.Array.from_buffers(pa.binary(), len(words.starts), [None, pa.py_buffer(ends), pa.py_buffer(words.data[~NO_TERM[words.data]])]))
    (lang, langs), (source, names) = (ranked(pc.fill_null(batch.column(c), "")) for c in ("lang", "source"))
    leaf = lang[words.doc] * len(terms) + term
    once, _ = grouped(words.doc * len(terms) + term)
    documents = grouped(lang[once // len(terms)] * len(terms) + once % len(terms))
    entry, count = grouped(leaf * len(names) + source[words.doc])
    of = entry // len(names)
    widths = np.diff(np.searchsorted(of, np.r_[documents[0], len(langs) * len(terms)]))
    whole = Trie(terms.take(pa.array(documents[0] % len(terms))), documents[1], widths, names, entry % len(names), count)
    cuts = np.searchsorted(documents[0], np.arange(len(langs) + 1) * len(terms)).tolist()
    for i, name in enumerate(langs.to_pylist()):
        if cuts[i] < cuts[i + 1]:
            yield name, whole.part(cuts[i], cuts[i + 1])


def _counting(p: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def together():  # small batches of rows as one
            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size >= p.text_bytes:
                    yield from slices(iter(pa.Table.from_batches(held).combine_chunks().to_batches()), limit=p.text_bytes)
                    held, size = [], 0
            if held:
                yield from slices(iter(pa.Table.from_batches(held).combine_chunks().to_batches()), limit=p.text_bytes)

        for batch in together():
            for lang, trie in counted(batch):
                yield trie.rows(lang, p.prefix)
        release()

    return run


def _grown(table: pa.Table) -> Trie:
    """The trie of rows of subtries of one language."""
    column = lambda name: table.column(name).combine_chunks()
    suffixes = column("suffixes")
    head = column("prefix").take(pa.array(np.repeat(np.arange(table.num_rows), pc.list_value_length(suffixes).to_numpy(zero_copy_only=False))))
    terms = pc.binary_join_element_wise(head, suffixes.flatten(), b"")
    source, names = ranked(column("sources").flatten())
    values = [column(c).flatten().to_numpy(zero_copy_only=False) for c in ("documents", "widths", "counts")]
    return Trie.merged(terms, values[0], values[1], names, source, values[2])


def _merging(p: Settings):
    def cells(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for lang in pc.unique(table.column("lang")).to_pylist():
            trie = _grown(table.filter(pc.equal(table.column("lang"), lang))).kept(p.least)
            for a in range(0, len(trie.terms), p.cell):
                yield trie.part(a, min(a + p.cell, len(trie.terms))).cell(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # rows that may not be all of their prefix yet
        for batch in batches:
            if not batch.num_rows:
                continue
            last = pc.and_(pc.equal(batch.column("lang"), batch.column("lang")[-1]), pc.equal(batch.column("prefix"), batch.column("prefix")[-1])).to_numpy(zero_copy_only=False)
            cut = int(np.argmax(last))  # in order, so the last prefix starts here
            same = held and held[-1].column("lang")[-1] == batch.column("lang")[-1] and held[-1].column("prefix")[-1] == batch.column("prefix")[-1]
            if cut or (held and not same):
                done = [*held, batch.slice(0, cut)] if cut else held
                yield from cells(pa.Table.from_batches(done))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from cells(pa.Table.from_batches(held))
        release()

    return run


def kept_terms(docs: DataFrame, p: Settings) -> DataFrame:
    """lang, terms (bytes, ascending), widths, sources, counts (by source, of each), totals, n_terms: the terms in enough documents of a language, in cells."""
    tries = stored(docs.select("text", "lang", "source").mapInArrow(_counting(p), _SUBTRIE))
    cells = stored(tries.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix").mapInArrow(_merging(p), _CELL))
    discard(tries)
    return cells


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total), exact for totals up to 9e15: a thousandth at a time."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Walk:
    """What a walk over the cells of one language gathers: sums of pairs, and candidates of each source."""

    def __init__(self, known: list[dict], all_terms: int, top: int):
        self.names, self.top = [s["source"] for s in known], top
        self.totals, self.all_terms = np.array([s["n"] for s in known], np.int64), all_terms
        self.sums = np.zeros((len(known), len(known)), np.int64)
        self.values, self.terms = ([np.empty(0, np.int64)] * len(known), [pa.array([], pa.binary())] * len(known))

    def cell(self, terms: pa.Array, widths: np.ndarray, sources: pa.Array, counts: np.ndarray) -> None:
        n = np.zeros((len(terms), len(self.names)), np.int64)
        n[np.repeat(np.arange(len(terms)), widths), pc.index_in(sources, pa.array(self.names)).to_numpy(zero_copy_only=False)] = counts
        p = shares(n + 1, self.totals + self.all_terms)
        q = shares(n.sum(axis=1) + 1, self.totals.sum() + self.all_terms)
        for j in range(len(self.names)):
            self.sums[j] += gaps(p[:, j : j + 1], p).sum(axis=0)
            at = np.flatnonzero((n[:, j] > 0) & (p[:, j] > q))
            if len(at):
                value = np.r_[self.values[j], gaps(p[at, j], q[at])]
                names = pa.concat_arrays([self.terms[j], terms.take(pa.array(at))])
                place, _ = ranked(names)
                first = np.lexsort((place, -value))[: self.top]
                self.values[j], self.terms[j] = value[first], names.take(pa.array(first))

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        for j, source in enumerate(self.names):
            others = [o for o in range(len(self.names)) if o != j]
            items = [self.names[o] for o in others] + self.terms[j].cast(pa.string()).to_pylist()
            parts = ["pair"] * len(others) + ["term"] * len(self.values[j])
            value = pa.array(np.r_[self.sums[j][others], self.values[j]].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array([source] * len(items), pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.string()), value], ["lang", "source", "part", "item", "value"])


def _walking(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[str, Walk] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                lang = value["lang"].as_py()
                if lang not in walks:
                    walks[lang] = Walk(value["known"].as_py(), value["all_terms"].as_py(), top)
                numbers = (value[c].values.to_numpy(zero_copy_only=False) for c in ("widths", "counts"))
                widths, counts = numbers
                walks[lang].cell(value["terms"].values, widths, value["sources"].values, counts)
        for lang, walk in walks.items():
            yield from walk.rows(lang)

    return run


def source_divergence(docs: DataFrame, p: Settings = Settings()) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source): all other sources ('pair') and the terms ('term') of each source, furthest first."""
    prepare(docs.sparkSession)
    docs = docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    cells = kept_terms(docs, p)
    groups = stored(docs.select("lang", "source").distinct())
    totals = cells.select("lang", F.explode("totals").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sized = cells.groupBy("lang").agg(F.sum("n_terms").alias("all_terms"))
    tasks = max(1, -(-(cells.agg(F.sum("n_terms")).collect()[0][0] or 0) // p.share))
    known = groups.join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("known"))
    known = known.join(sized, "lang").withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = cells.withColumn("task", F.pmod(F.xxhash64(F.col("terms")[0]), F.lit(tasks)).cast("int"))
    walked = dealt.join(known, ["lang", "task"]).select("lang", "terms", "widths", "sources", "counts", "known", "all_terms")
    found = stored(walked.mapInArrow(_walking(p.top), "lang string, source string, part string, item string, value long"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("part", F.lit("pair"))
    summed = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    columns = ["lang", "source", "part", "item", "value"]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = [x.select(*columns, F.row_number().over(order).alias("rank")) for x in (pairs, found.where("part = 'term'"))]
    return told[0].unionByName(told[1].where(F.col("rank") <= p.top))
