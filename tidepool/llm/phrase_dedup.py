"""Substring dedup by repeated-phrase automata: words inside a phrase that a document with a smaller id holds too.

1. Exact copies of a text are one text, held by its smallest doc_id; the others lose everything if they have a phrase at all.
2. Phrases (windows of ``window`` consecutive words) meet by their anchors (``anchors``); the words of one occurrence's windows
   are a segment, as 32-bit word codes. Equal segments are one, with the smallest and largest doc_id that hold it.
3. Segments of one anchor come together in a shard. Phrases that occur under two doc_ids are confirmed there and compiled into an
   Aho-Corasick automaton over word codes, each with the smallest doc_id that holds it; all segments are streamed through it.
4. An anchor with very many different segments is cut into single phrases, so that no shard grows with it.

Words are ``[^\\x20\\x09-\\x0D]+``; null texts have none. Ids are of any type with an order. A null doc_id is neither smaller nor larger than any: such rows keep all
their words. Rows with the same doc_id don't count against each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepool.llm import anchors as an
from tidepool.llm.runtime import discard, prepare, stored
from tidepool.llm.textbuf import U64, Words, covered, mix, prefix, rolling, slices, span, text_buffers


@dataclass(frozen=True)
class Settings:
    """``window`` words make a phrase, ``gram`` words an anchor. A shard takes about ``shard_windows`` phrases and,
    of one anchor, up to ``crowd`` different segments."""

    window: int = 13
    gram: int = 4
    shard_windows: int = 40_000
    crowd: int = 4000


def _occurrences(words: Words, p: Settings):
    hashes = words.hashes()
    return hashes, *an.occurrences(rolling(prefix(hashes), p.gram), p.gram, p.window, words.first)


def _anchors(texts: DataFrame, p: Settings) -> DataFrame:
    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            words = Words(*text_buffers(batch.column("text")))
            _, doc, anchor, *_ = _occurrences(words, p)
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            owner = pa.array(doc[fresh])
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(owner), batch.column("t2").take(owner), pa.array(anchor[fresh].view(np.int64))], ["t1", "t2", "anchor"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, anchor long").withColumn("multi", F.lit(False))


_SEGMENT = "key long, d1 long, d2 long, t1 long, t2 long, id {id}, places array<long>, windows int, codes binary"


def _digests(window, codes, first, last):
    """128 bits that stand for a segment's words."""
    end = last + window
    pre = prefix(mix(codes.astype(U64) + U64(1)))
    d1 = span(pre, first, end)
    return d1, mix(span(pre, (first + end) // 2, end) + mix(d1 ^ U64(3)))


def _segment_batch(window, key, d1, d2, texts, places, codes, first, last):
    """Segments ``first`` to ``last + window`` of the joined ``codes``, each with its text (t1, t2, id) and the word positions at which that holds it."""
    raw, end = codes.tobytes(), last + window
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), *texts, places, pa.array((last - first + 1).astype(np.int32)), pa.array([raw[4 * a : 4 * b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())],
        ["key", "d1", "d2", "t1", "t2", "id", "places", "windows", "codes"],
    )


def _segments(texts: DataFrame, p: Settings) -> DataFrame:
    def run(batches):
        for batch in slices(batches, limit=2 << 20):
            words = Words(*text_buffers(batch.column("text")))
            hashes, doc, anchor, _, first, last = _occurrences(words, p)
            hit = an.members(anchor.view(np.int64), an.lists(batch.column("anchors")), doc, len(words.count))
            doc, anchor, first, last = doc[hit], anchor[hit], first[hit], last[hit]
            codes = (hashes >> U64(32)).astype(np.uint32)
            d1, d2 = _digests(p.window, codes, first, last)
            lead, order, bounds = an.once_each(doc, anchor, d1, d2)
            places, owner = an.place_lists(first - words.first[doc], order, bounds), pa.array(doc[lead])
            yield _segment_batch(p.window, anchor[lead], d1[lead], d2[lead], [batch.column(c).take(owner) for c in ("t1", "t2", "doc_id")], places, codes, first[lead], last[lead])

    return texts.select("doc_id", "t1", "t2", "text", "anchors").mapInArrow(run, _SEGMENT.format(id=texts.schema["doc_id"].dataType.simpleString()))


def _single(segments: DataFrame, p: Settings) -> DataFrame:
    """Every phrase of every segment as a segment of its own, keyed by its content."""

    def run(batches):
        for batch in (piece for whole in batches for piece in an.pieces(whole)):
            parts = batch.column("codes").to_pylist()
            windows, key = (batch.column(c).to_numpy() for c in ("windows", "key"))
            begins = an.lists(batch.column("places"))
            codes = np.frombuffer(b"".join(parts), np.uint32)
            base = np.r_[0, np.cumsum([len(x) // 4 for x in parts])]
            row = np.repeat(np.arange(len(parts)), windows)
            inner = np.arange(len(row)) - np.r_[0, np.cumsum(windows)][row]
            first = base[row] + inner
            made = mix(span(prefix(mix(codes.astype(U64) + U64(2))), first, first + p.window) ^ mix(key[row].view(U64)))
            moved = [begins[r] + i for r, i in zip(row.tolist(), inner.tolist(), strict=True)]
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in moved])].astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *moved])))
            d1, d2 = _digests(p.window, codes, first, first)
            yield _segment_batch(p.window, made, d1, d2, [batch.column(c).take(pa.array(row)) for c in ("t1", "t2", "id")], places, codes, first, first)

    return segments.mapInArrow(run, segments.schema)


def _located(distinct: DataFrame, p: Settings) -> DataFrame:
    """(key, d1, d2, holders): for each phrase of a distinct segment the smallest doc_id that holds it, null if only one doc_id does."""

    kind = distinct.schema["least"].dataType
    arrow = to_arrow_type(kind)

    def shard(rows: list[tuple]):
        key, d1, d2, least, most, windows, parts = zip(*rows, strict=True)
        codes = np.frombuffer(b"".join(parts), np.uint32)
        base = np.r_[0, np.cumsum([len(x) // 4 for x in parts])][:-1]
        windows = np.array(windows)
        row = np.repeat(np.arange(len(rows)), windows)
        first = base[row] + np.arange(len(row)) - np.r_[0, np.cumsum(windows)][row]
        phrase = span(prefix(mix(codes.astype(U64) + U64(2))), first, first + p.window)
        order = np.argsort(phrase, kind="stable")
        cut = np.flatnonzero(np.r_[True, phrase[order[1:]] != phrase[order[:-1]]])
        # Ids by their place in order, so that those of any kind are compared as numbers.
        ids, at = np.unique(np.array(least + most), return_inverse=True)
        holder = np.minimum.reduceat(at[: len(rows)][row[order]], cut)
        recurring = holder < np.maximum.reduceat(at[len(rows) :][row[order]], cut)
        ids = ids.tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        listed = codes.tolist()
        for a, who in zip(first[order[cut[recurring]]].tolist(), holder[recurring].tolist(), strict=True):
            automaton.add_word(tuple(listed[a : a + p.window]), ids[who])
        out = []
        if len(automaton):
            automaton.make_automaton()
            for i, part in enumerate(parts):
                found = None
                a = int(base[i])
                for end, who in automaton.iter(tuple(listed[a : a + len(part) // 4])):
                    if found is None:
                        found = [None] * int(windows[i])
                    found[end - p.window + 1] = who
                if found is not None:
                    out.append((key[i], d1[i], d2[i], found))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(arrow)]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["key", "d1", "d2", "holders"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "least", "most", "windows", "codes")), strict=True):
                if size >= p.shard_windows and rows[-1][0] != row[0]:
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[5]
        if rows:
            yield shard(rows)

    dealt = distinct.repartition("key").sortWithinPartitions("key", "d1", "d2")
    return dealt.select("key", "d1", "d2", "least", "most", "windows", "codes").mapInArrow(run, f"key long, d1 long, d2 long, holders array<{kind.simpleString()}>")


def repeated_phrases(docs: DataFrame, p: Settings) -> DataFrame:
    """(t1, t2, starts): word positions of phrases that a smaller doc_id holds, for each text, as its smallest doc_id holds it."""
    texts = an.exact_copies(docs)
    anchors = stored(_anchors(texts, p))
    # One row a text is enough, the one with the smallest doc_id; its text is shuffled once.
    marks = stored(an.repeated(anchors))
    first = texts.where(F.col("doc_id").isNotNull()).groupBy("t1", "t2").agg(F.min("doc_id").alias("least"))
    wanted = marks.join(first, ["t1", "t2"]).withColumnsRenamed({"t1": "w1", "t2": "w2"})
    segments = stored(_segments(texts.join(wanted, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & (F.col("doc_id") == F.col("least"))), p))
    discard(anchors, marks)
    starts = None
    for last in (False, True):
        distinct = stored(segments.groupBy("key", "d1", "d2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first("windows").alias("windows"), F.first("codes").alias("codes")))
        kinds = distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.min("least").alias("low"), F.max("most").alias("high")).where("low <> high")
        kinds = stored(kinds.select("key", "kinds"))
        crowded = kinds.where(F.col("kinds") > p.crowd).select("key")
        more = not last and not crowded.isEmpty()
        small = distinct.join((kinds.where(F.col("kinds") <= p.crowd) if more else kinds).select("key"), "key", "left_semi")
        found = stored(_located(small, p))
        hits = segments.select("key", "d1", "d2", "t1", "t2", "id", "places").join(found, ["key", "d1", "d2"])
        inner = F.filter(F.transform("holders", lambda who, i: F.when(who < F.col("id"), i)), lambda x: x.isNotNull())
        at = F.flatten(F.transform("places", lambda x: F.transform(inner, lambda i: x + i)))
        part = stored(hits.select("t1", "t2", at.alias("starts")).where(F.size("starts") > 0))
        starts = part if starts is None else starts.unionByName(part)
        cut = stored(_single(segments.join(crowded, "key", "left_semi"), p)) if more else None
        discard(found, distinct, kinds, segments)
        if not more:
            break
        segments = cut
    return starts.groupBy("t1", "t2").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_phrases(docs: DataFrame, p: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed, span_starts, span_ends (removed runs, in words), kept (words left, joined by one space) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    starts = repeated_phrases(docs, p)
    texts = an.exact_copies(docs)
    known = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("least")).join(starts, ["t1", "t2"], "left").withColumnsRenamed({"t1": "w1", "t2": "w2"})
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            words = Words(data, offsets)
            known, later = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("known", "later"))
            at = an.lists(pc.fill_null(batch.column("starts"), []))
            gone = np.zeros(len(words.starts), bool)
            for d in np.flatnonzero(known & (words.count >= p.window)).tolist():
                a, b = words.first[d], words.first[d + 1]
                if later[d]:
                    gone[a:b] = True
                elif len(at[d]):
                    gone[a:b] = covered(b - a, at[d], at[d] + p.window)
            stay = np.flatnonzero(~gone)
            change = np.zeros(len(data) + 1, np.int32)
            change[words.starts[stay]] += 1
            np.subtract.at(change, words.ends[stay], 1)
            keep = np.cumsum(change[:-1]) > 0
            follows = stay[1:][words.doc[stay[1:]] == words.doc[stay[:-1]]]
            gap = words.starts[follows] - 1
            keep[gap] = True
            out = data.copy()
            out[gap] = 32
            bounds = np.r_[0, np.cumsum(keep)][offsets]
            kept = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[keep])]).cast(pa.string())
            edge = np.diff(np.r_[False, gone, False].astype(np.int8))
            opens, closes = edge[:-1] == 1, edge[1:] == -1
            inner = words.first[:-1][words.doc[1:]][words.doc[1:] != words.doc[:-1]] if len(gone) else np.empty(0, np.int64)
            inner = inner[(inner > 0) & gone[inner] & gone[inner - 1]] if len(gone) else inner
            opens[inner], closes[inner - 1] = True, True
            opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            cut = np.searchsorted(opens, words.first).astype(np.int32)
            owner = words.doc[opens]
            span_starts = pa.ListArray.from_arrays(pa.array(cut), pa.array(opens - words.first[owner]))
            span_ends = pa.ListArray.from_arrays(pa.array(cut), pa.array(closes - words.first[owner]))
            n_removed = np.r_[0, np.cumsum(gone)][words.first]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.array(np.diff(n_removed).astype(np.int64)), span_starts, span_ends, kept], ["doc_id", "n_words", "n_removed", "span_starts", "span_ends", "kept"])

    joined = texts.join(known, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2"))).select("doc_id", "text", F.col("doc_id").isNotNull().alias("known"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("later"), "starts")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, span_starts array<long>, span_ends array<long>, kept string")


