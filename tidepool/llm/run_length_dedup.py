"""Suffix-array dedup by a run-length index: every byte inside a long string that starts elsewhere too.

1. Exact copies of a text are one text that occurs several times.
2. Windows of ``least`` bytes meet by their anchors (``anchors``); a segment begins at the first window of an
   occurrence and ends ``length`` bytes after its last one begins (or with the text), so equal strings of
   ``length`` bytes lie in segments of one anchor. Equal segments are one segment that occurs several times.
3. Segments of one anchor come together in a shard. There a suffix array gives the run-compressed
   Burrows-Wheeler transform, with the length of the match across each border of two runs sampled; the array
   itself is dropped. All segments then stream through the runs side by side, a byte a step: where a row lies at
   an end of its run its match is read from the sample, elsewhere it is one byte shorter than the step before.
   Besides, windows of ``least`` bytes that are equal and lie alike to their anchor are marked as shared. A string
   of ``length`` bytes can only repeat where such windows do, so segments are cut to these before they are indexed.
4. An anchor with very many different segments is cut into blocks of windows (keyed by what the
   block's windows have in common), in the end into single windows, so that no shard grows with it.

Texts are UTF-8 bytes; null counts as empty. Matches never cross documents. All rows of a text that
occurs twice lose everything if it has ``length`` bytes. Null doc_ids are carried through, extra columns are not
looked at, an empty table gives no rows. A very long text is held whole by the task that reads it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm import anchors as an
from tidepool.llm.runtime import discard, prepare, stored
from tidepool.llm.textbuf import U64, byte_prefix, covered, duplicated, mix, ranges, release, rolling, slices, span, text_buffers


@dataclass(frozen=True)
class Settings:
    """``length`` bytes make a repeat that goes, ``least`` bytes one that is only counted; ``gram`` bytes make an anchor.

    A shard takes about ``shard_bytes`` and, of one anchor, up to ``crowd`` different segments; an anchor with more
    is cut into blocks of ``block_windows``.
    """

    length: int = 400
    least: int = 240
    gram: int = 96
    shard_bytes: int = 1 << 20
    crowd: int = 4000
    block_windows: int = 32


_SYMBOLS = 7  # nine-bit symbols in the first sort key
CACHED = 1 << 16  # bytes of text whose 64-bit hashes and temporaries stay in a core's cache


@dataclass
class RunLengthIndex:
    """Run-compressed transform of segments joined by separators.

    Run i holds ``symbols[i]`` from row ``run_starts[i]`` on; ``matches[i]`` is the match of that row's text with
    the row above. ``entries`` are the rows at which the segments begin.
    """

    n: int
    symbols: np.ndarray
    run_starts: np.ndarray
    matches: np.ndarray
    entries: np.ndarray

    def matching_statistics(self, windows: np.ndarray) -> np.ndarray:
        """For the first ``windows[i]`` bytes of each segment i in turn: the longest match that starts at another place, up to its segment's end."""
        sizes = np.diff(np.r_[self.run_starts, self.n])
        by_symbol = np.argsort(self.symbols, kind="stable")
        image = np.r_[0, np.cumsum(sizes[by_symbol])][:-1]  # the first row whose text begins with a run's symbol, run by run
        below = np.r_[self.matches[1:], 0]
        base = np.r_[0, np.cumsum(windows)]
        out = np.zeros(base[-1], np.int64)
        lanes = np.argsort(-windows, kind="stable")
        reach = np.searchsorted(-windows[lanes], -np.arange(1, int(windows.max(initial=0)) + 1), "right").tolist()
        rows = self.entries[lanes]
        run = np.searchsorted(self.run_starts, rows, "right") - 1
        up, down = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        for step, many in enumerate(reach):
            if step:  # to the row of the text that begins one byte later
                rows, up, down = rows[:many], up[:many], down[:many]
                at = np.searchsorted(image, rows, "right") - 1
                run = by_symbol[at]
                rows = self.run_starts[run] + (rows - image[at])
            inner = rows - self.run_starts[run]
            up = np.where(inner == 0, self.matches[run], up - 1)
            down = np.where(inner == sizes[run] - 1, below[run], down - 1)
            out[base[lanes[:many]] + step] = np.maximum(up, down)
        return out


def suffix_ranks(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix array, [(length, rank of each position's next ``length`` symbols)]) by doubling; only open groups are sorted again.

    ``text`` has symbols from 1 on and 0 at the separators ``ends``, each of which is smaller than all others after it.
    """
    n = len(text)
    to_end = np.repeat(ends.astype(np.int32), np.diff(np.r_[-1, ends])) - np.arange(n, dtype=np.int32)
    whole = np.r_[text, np.zeros(_SYMBOLS, text.dtype)].astype(U64)
    two = (whole[:-1] << U64(9)) | whole[1:]
    four = (two[:-2] << U64(18)) | two[2:]
    key = (four[:n] << U64(27)) | ((two[4 : n + 4] << U64(9)) | whole[6 : n + 6])
    short = np.minimum(to_end, np.int32(_SYMBOLS))
    del whole, two, four
    key &= ~((U64(1) << (U64(9) * (U64(_SYMBOLS) - short.astype(U64)))) - U64(1))
    order = np.argsort(key)
    sorted_key = key[order]
    equal = np.r_[False, sorted_key[1:] == sorted_key[:-1]]
    # Texts that end within the key are in the order of their separators.
    tied = np.flatnonzero((equal | np.r_[equal[1:], False]) & (to_end[order] < _SYMBOLS))
    order[tied] = order[tied][np.lexsort((order[tied], sorted_key[tied]))]
    order = order.astype(np.int32)
    fresh = ~equal | (to_end[order] < _SYMBOLS)
    rank = np.empty(n, np.int32)
    group = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), np.int32(0)))
    rank[order] = group
    levels = [(_SYMBOLS, rank)]
    length = _SYMBOLS
    open_at = np.flatnonzero(~(fresh & np.r_[fresh[1:], True])).astype(np.int32)
    pos, group = order[open_at], group[open_at]
    rank_bits = U64(n.bit_length())
    while len(open_at):
        many = len(open_at)
        place_bits = U64(many.bit_length())
        both = (group.astype(U64) << rank_bits) | rank[np.minimum(pos + np.int32(length), np.int32(n - 1))].view(np.uint32)
        # Where 64 bits hold it, the place goes into the key: a plain sort is far faster than an argsort.
        if 2 * int(rank_bits) + int(place_bits) <= 64:
            both <<= place_bits
            both |= np.arange(many, dtype=U64)
            both.sort()
            again = (both & ((U64(1) << place_bits) - U64(1))).astype(np.int32)
            both >>= place_bits
        else:
            again = np.argsort(both)
            both = both[again]
        order[open_at] = pos = pos[again]
        split = np.r_[True, both[1:] != both[:-1]]
        group = np.maximum.accumulate(np.where(split, open_at, np.int32(0)))
        rank = rank.copy()
        rank[pos] = group
        length *= 2
        levels.append((length, rank))
        still = np.flatnonzero(~(split & np.r_[split[1:], True]))
        open_at, pos, group = open_at[still], pos[still], group[still]
    return order, levels


def build_index(data: np.ndarray, offsets: np.ndarray, least: int = 0) -> RunLengthIndex:
    """Index of segments given as bytes and bounds. Matches shorter than ``least`` may be sampled as 0."""
    count = len(offsets) - 1
    starts = offsets[:-1] + np.arange(count)
    ends = offsets[1:] + np.arange(count)
    text = np.zeros(len(data) + count, np.int16)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = data.astype(np.int16) + 1
    order, levels = suffix_ranks(text, ends)
    before = text[order - 1]
    # Separators differ from one another, so each is a run of its own.
    border = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] == 0)) + 1
    last = np.int32(len(text) - 1)
    # One level tells most of the borders whose match is shorter than ``least``.
    rank = max((level for level in levels if level[0] <= least), key=lambda level: level[0], default=(0, None))[1]
    tried = np.arange(len(border)) if rank is None else np.flatnonzero(rank[order[border - 1]] == rank[order[border]])
    x, y = order[border[tried] - 1], order[border[tried]]
    found = np.zeros(len(tried), np.int32)
    for length, rank in reversed(levels):
        same = (rank[np.minimum(x, last)] == rank[np.minimum(y, last)]) & (x <= last) & (y <= last)
        step = same * np.int32(length)
        found += step
        x += step
        y += step
    open_at = np.arange(len(tried))
    for _ in range(_SYMBOLS - 1):
        a, b = text[np.minimum(x[open_at], last)], text[np.minimum(y[open_at], last)]
        open_at = open_at[(a == b) & (a > 0) & (x[open_at] <= last) & (y[open_at] <= last)]
        found[open_at] += 1
        x[open_at] += 1
        y[open_at] += 1
    match = np.zeros(len(border), np.int32)
    match[tried] = found
    first = np.flatnonzero(before == 0)
    entries = np.empty(count, np.int64)
    entries[np.searchsorted(starts, order[first])] = first
    run_starts = np.r_[0, border]
    return RunLengthIndex(len(text), before[run_starts], run_starts, np.r_[0, match].astype(np.int64), entries)


def _anchors(texts: DataFrame, p: Settings) -> DataFrame:
    def run(batches):
        for batch in slices(batches, limit=CACHED):
            data, offsets = text_buffers(batch.column("text"))
            if len(data) < p.least:
                continue
            doc, anchor, *_ = an.occurrences(rolling(byte_prefix(data), p.gram), p.gram, p.least, offsets)
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            first = np.flatnonzero(fresh)
            multi = np.diff(np.r_[first, len(doc)]) > 1
            owner = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([batch.column("t1").take(owner), batch.column("t2").take(owner), pa.array(anchor[first].view(np.int64)), pa.array(multi)], ["t1", "t2", "anchor", "multi"])

    return texts.select("t1", "t2", "text").mapInArrow(run, "t1 long, t2 long, anchor long, multi boolean")


_SEGMENT = "key long, d1 long, d2 long, t1 long, t2 long, places array<long>, windows long, anchor_at long, bytes binary"


def _segments(texts: DataFrame, p: Settings) -> DataFrame:
    """Segments of every repeated anchor of ``texts`` (t1, t2, text, anchors); ``places`` are the byte positions in the text at which it begins."""

    def run(batches):
        for batch in slices(batches, limit=2 * CACHED):
            data, offsets = text_buffers(batch.column("text"))
            pre = byte_prefix(data)
            doc, anchor, at, first, last = an.occurrences(rolling(pre, p.gram), p.gram, p.least, offsets)
            hit = an.members(anchor.view(np.int64), an.lists(batch.column("anchors")), doc, len(offsets) - 1)
            doc, anchor, at, first, last = doc[hit], anchor[hit], at[hit], first[hit], last[hit]
            end = np.minimum(last + p.length, offsets[doc + 1])
            d1, d2 = _digests(pre, first, end, at)
            lead, order, bounds = an.once_each(doc, anchor, d1, d2)
            places, owner = an.place_lists(first - offsets[doc], order, bounds), pa.array(doc[lead])
            yield _segment_batch(batch.column("t1").take(owner), batch.column("t2").take(owner), anchor[lead], d1[lead], d2[lead], places, data, first[lead], last[lead], end[lead], at[lead])

    return texts.select("t1", "t2", "text", "anchors").mapInArrow(run, _SEGMENT)


def _digests(pre, first, end, at):
    """128 bits that stand for a segment's bytes and for where its anchor lies."""
    d1 = span(pre, first, end)
    return d1, mix(span(pre, (first + end) // 2, end) ^ mix((at - first).astype(U64) + U64(17)) ^ mix(d1 + U64(5)))


def _segment_batch(t1, t2, key, d1, d2, places, data, first, last, end, at):
    raw = data.tobytes()
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), t1, t2, places, pa.array(last - first + 1), pa.array(at - first), pa.array([raw[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)], pa.binary())],
        ["key", "d1", "d2", "t1", "t2", "places", "windows", "anchor_at", "bytes"],
    )


def _blocks(segments: DataFrame, width: int, p: Settings) -> DataFrame:
    """The same windows in segments of at most ``width``, keyed by the bytes that all windows of a block share."""

    def run(batches):
        for batch in (piece for part in slices(batches, column="bytes", limit=1 << 20) for piece in an.pieces(part)):
            data, offsets = text_buffers(batch.column("bytes").cast(pa.large_binary()).view(pa.large_string()))
            pre = byte_prefix(data)
            windows, lead, key = (batch.column(c).to_numpy() for c in ("windows", "anchor_at", "key"))
            begins = an.lists(batch.column("places"))
            # A window's offset is how far before the anchor it starts; blocks are runs of offsets.
            high, low = lead, lead - windows + 1
            top, bottom = high // width, low // width
            row = np.repeat(np.arange(len(key)), top - bottom + 1)
            block = top[row] - (np.arange(len(row)) - np.r_[0, np.cumsum(top - bottom + 1)][row])
            far, near = np.minimum(high[row], block * width + width - 1), np.maximum(low[row], block * width)
            anchor = offsets[row] + lead[row]
            core = span(pre, anchor - block * width, anchor - (block * width + width - 1) + p.least)
            made = mix(core ^ mix(key[row].view(U64) + block.astype(U64)))
            first, last = anchor - far, anchor - near
            moved = [begins[r] + f for r, f in zip(row.tolist(), (first - offsets[row]).tolist(), strict=True)]
            places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in moved])].astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *moved])))
            end, owner = np.minimum(last + p.length, offsets[row + 1]), pa.array(row)
            d1, d2 = _digests(pre, first, end, anchor)
            yield _segment_batch(batch.column("t1").take(owner), batch.column("t2").take(owner), made, d1, d2, places, data, first, last, end, anchor)

    return segments.mapInArrow(run, _SEGMENT)


_RANGES = ("starts", "ends", "shared_starts", "shared_ends")


def _joined(marked: np.ndarray, row: np.ndarray, place: np.ndarray, size: int, wanted: np.ndarray) -> list[pa.ListArray]:
    """(starts, ends) in each of the rows ``wanted``: ranges that strings of ``size`` bytes cover where they begin at ``marked`` entries."""
    at = np.flatnonzero(marked)
    cut = np.flatnonzero((np.diff(row[at]) > 0) | (np.diff(at) > size)) + 1
    opens, closes = (at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1]) if len(at) else (at, at)
    bounds = pa.array(np.r_[np.searchsorted(row[opens], wanted), len(opens)].astype(np.int32))
    return [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (place[opens], place[closes] + size)]


def _candidates(twin: np.ndarray, whole: np.ndarray, row: np.ndarray, place: np.ndarray, further: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first place, last place) of the part of each segment in which a repeat can begin; the index needs no more of it.

    All windows of ``least`` bytes within a repeat have a ``twin`` in another segment: the one at which it begins
    and the ``further`` ones behind it, as far as they are windows of this segment.
    """
    n = len(row)
    last = np.r_[row[1:] != row[:-1], True]
    stops = np.flatnonzero(~twin)
    to_stop = np.r_[stops, n][np.searchsorted(stops, np.arange(n))]
    ends = np.flatnonzero(last)
    to_end = ends[np.searchsorted(ends, np.arange(n))] + 1
    at = np.flatnonzero(twin & whole & (to_stop >= np.minimum(np.arange(n) + further + 1, to_end)))
    first = np.flatnonzero(np.r_[True, row[at[1:]] != row[at[:-1]]]) if len(at) else at
    return row[at[first]], place[at[first]], place[at[np.r_[first[1:], len(at)] - 1]] if len(at) else at


def _parts(key: np.ndarray, sizes: np.ndarray, limit: int):
    """Bounds of stretches of rows with about ``limit`` bytes each, that part no two rows of one key; an index takes some hundred times its text."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    total = np.r_[0, np.cumsum(sizes)]
    bounds = np.r_[starts, len(key)].tolist()
    a = 0
    for now, after in zip(bounds[:-1], bounds[1:], strict=True):
        if now > a and total[after] - total[a] > limit:
            yield a, now
            a = now
    if a < len(key):
        yield a, len(key)


def _shard(rows: list[tuple], p: Settings) -> pa.RecordBatch:
    """(key, d1, d2, starts, ends, shared_starts, shared_ends) of those rows (key, d1, d2, times, windows, anchor_at, bytes) of a shard that have any."""
    key, d1, d2, times, windows, anchor_at, parts = zip(*rows, strict=True)
    sizes, windows = np.array([len(x) for x in parts]), np.array(windows)
    data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum(sizes)]
    row = np.repeat(np.arange(len(rows)), windows)
    place = np.arange(len(row)) - np.r_[0, np.cumsum(windows)][row]
    again = np.array(times)[row] > 1
    first = offsets[row] + place
    alike = span(byte_prefix(data), first, first + p.least) ^ mix(np.array(key)[row].view(U64) + (np.array(anchor_at)[row] - place).astype(U64))
    twin = duplicated(alike)
    shared = again | twin
    told = np.flatnonzero(np.logical_or.reduceat(shared, np.r_[0, np.cumsum(windows)[:-1]]))
    whole = sizes[row] - place >= p.length
    gone = again & whole
    held, low, high = _candidates(twin, whole, row, place, p.length - p.least)
    begin, end = offsets[held] + low, np.minimum(offsets[held] + high + p.length, offsets[held + 1])
    base, owner = np.r_[0, np.cumsum(windows)][held], np.array(key)[held]
    for a, b in _parts(owner, end - begin, p.shard_bytes // 4):
        part = slice(a, b)
        index = build_index(data[ranges(begin[part], end[part])], np.r_[0, np.cumsum((end - begin)[part])], p.length)
        gone[ranges((base + low)[part], (base + high)[part] + 1)] |= index.matching_statistics((high - low + 1)[part]) >= p.length
        del index
    lists = [*_joined(gone, row, place, p.length, told), *_joined(shared, row, place, p.least, told)]
    return pa.RecordBatch.from_arrays([*(pa.array(np.array(x, np.int64)[told]) for x in (key, d1, d2)), *lists], ["key", "d1", "d2", *_RANGES])


def _marked(distinct: DataFrame, p: Settings) -> DataFrame:
    """(key, d1, d2, starts, ends, shared_starts, shared_ends): the ranges of each distinct segment that repeats of ``length`` and of ``least`` bytes cover."""

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "d1", "d2", "times", "windows", "anchor_at", "bytes")), strict=True):
                if size >= p.shard_bytes and rows[-1][0] != row[0]:
                    yield _shard(rows, p)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[6])
        if rows:
            yield _shard(rows, p)
        rows = None
        release()

    dealt = distinct.repartition("key").sortWithinPartitions("key", "d1", "d2")
    return dealt.select("key", "d1", "d2", "times", "windows", "anchor_at", "bytes").mapInArrow(run, "key long, d1 long, d2 long" + "".join(f", {c} array<long>" for c in _RANGES))


def _distinct(segments: DataFrame) -> DataFrame:
    return segments.groupBy("key", "d1", "d2").agg(F.sum(F.size("places")).alias("times"), *(F.first(c).alias(c) for c in ("windows", "anchor_at", "bytes")))


def repeated_ranges(docs: DataFrame, p: Settings) -> DataFrame:
    """(t1, t2, starts, ends, shared_starts, shared_ends) of each different text with any: byte ranges that repeats cover. They may overlap."""
    texts = an.exact_copies(docs)
    anchors = stored(_anchors(texts, p))
    marks = stored(an.repeated(anchors))
    # One row a text is enough, that with the least doc_id; equal rows only repeat it. Its text is shuffled once.
    first = texts.groupBy("t1", "t2").agg(F.min("doc_id").alias("least"))
    wanted = marks.join(first, ["t1", "t2"]).withColumnsRenamed({"t1": "w1", "t2": "w2"}).hint("merge")
    least = F.coalesce(F.col("doc_id") == F.col("least"), F.col("least").isNull())
    segments = stored(_segments(texts.join(wanted, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")) & least), p))
    discard(anchors, marks)
    ranges = None
    # An anchor of few different segments goes to a shard; one of many is cut further.
    for width in (p.block_windows, 1, 0):
        distinct = stored(_distinct(segments))
        kinds = stored(distinct.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("times").alias("n")).where("n > 1"))
        crowded = kinds.where(F.col("kinds") > p.crowd).select("key")
        more = width > 0 and not crowded.isEmpty()
        small = distinct.join((kinds.where(F.col("kinds") <= p.crowd) if more else kinds).select("key"), "key", "left_semi")
        found = stored(_marked(small, p))
        spread = lambda c: F.flatten(F.transform("places", lambda x: F.transform(c, lambda y: x + y))).alias(c)
        part = stored(segments.select("key", "d1", "d2", "t1", "t2", "places").join(found, ["key", "d1", "d2"]).select("t1", "t2", *map(spread, _RANGES)))
        ranges = part if ranges is None else ranges.unionByName(part)
        cut = stored(_blocks(segments.join(crowded, "key", "left_semi"), width, p)) if more else None
        discard(found, distinct, kinds, segments)
        if not more:
            break
        segments = cut
    return ranges.groupBy("t1", "t2").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in _RANGES))


def remove_repeats(docs: DataFrame, p: Settings = Settings(), carry: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """doc_id, the columns ``carry``, n_bytes, span_starts, span_ends (maximal removed runs), n_shared, kept of every row of ``docs``.

    ``n_shared`` are the bytes that strings of ``least`` bytes cover which start elsewhere too: passages that are too
    short to go count there. ``kept`` are the remaining bytes, or with ``as_text`` the text in them without the
    halves of characters cut at a run's edge.
    """
    if not p.gram <= p.least <= p.length:
        raise ValueError("gram <= least <= length must hold")
    spark = docs.sparkSession
    prepare(spark)
    ranges = repeated_ranges(docs, p)
    texts = an.exact_copies(docs, carry)
    columns = ["doc_id", *carry]
    copies = texts.groupBy("t1", "t2").agg(F.count("*").alias("copies"))

    def run(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column("text"))
            starts, ends, near, near_ends = (an.lists(pc.fill_null(batch.column(c), [])) for c in _RANGES)
            copies = batch.column("copies").to_numpy()
            kept, run_starts, run_ends = [], [], []
            sizes = np.diff(offsets)
            shared = np.where((copies > 1) & (sizes >= p.least), sizes, 0)
            for d in np.flatnonzero(copies == 1).tolist():
                shared[d] = covered(int(sizes[d]), near[d], near_ends[d]).sum() if len(near[d]) else 0
            for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                n = b - a
                if copies[d] > 1 and n >= p.length:
                    gone = np.ones(n, bool)
                elif len(starts[d]):
                    gone = covered(n, starts[d], ends[d])
                else:
                    kept.append(data[a:b].tobytes())
                    run_starts.append([])
                    run_ends.append([])
                    continue
                edge = np.diff(np.r_[False, gone, False].astype(np.int8))
                run_starts.append(np.flatnonzero(edge == 1).tolist())
                run_ends.append(np.flatnonzero(edge == -1).tolist())
                kept.append(data[a:b][~gone].tobytes())
            whole = pa.list_(pa.int64())
            left = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sizes), pa.array(run_starts, whole), pa.array(run_ends, whole), pa.array(shared), left], [*columns, "n_bytes", "span_starts", "span_ends", "n_shared", "kept"])

    known = copies.join(ranges, ["t1", "t2"], "left").withColumnsRenamed({"t1": "w1", "t2": "w2"}).hint("merge")
    joined = texts.join(known, (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2"))).select(*columns, "text", "copies", *_RANGES)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return joined.mapInArrow(run, f"{kinds}, n_bytes long, span_starts array<long>, span_ends array<long>, n_shared long, kept {'string' if as_text else 'binary'}")
