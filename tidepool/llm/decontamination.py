"""Benchmark decontamination by q-gram counting in diagonal bands.

Texts are compared by characters, in lower case (where that is one character) and with runs of white space
as one space. An item of n characters leaks into a document if a stretch of it is within k = RATE * n edits. Such a stretch shares at least
n + 1 - q - k q of the item's q-grams with the item (the q-gram lemma), all on diagonals that differ by at
most 2 k. So shared q-grams are counted in bands of diagonals that overlap by half, bands below the bound go,
and a banded alignment decides on the rest.

Items with fewer than LEAST characters allow no edit: an automaton finds them whole, with no letter or digit next
to them on either side.

The items' q-grams are sent to all tasks, ITEM_BYTES of item text at most; a larger benchmark is gone through
in several passes over the documents. Null and empty texts and items hold nothing and are found nowhere, null ids are
carried through, repeated rows give repeated results, further columns don't matter, and without documents or items there
are no rows. Of equally good stretches the first is reported. A very long text is held whole by the task that reads it.
"""

from __future__ import annotations

from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepool.llm.runtime import prepare
from tidepool.llm.textbuf import U64, mix, prefix, rolling, slices, text_buffers

Q, RATE, LEAST = 10, 0.06, 32
ITEM_BYTES = 8 << 20
FILTER_BITS = 22


_CASED = 0x1F000  # no character from here on has a case
_LOWER = np.arange(0x110000, dtype=np.uint32)
_LOWER[:_CASED] = [ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(_CASED)]
_SPACE = np.zeros(0x110000, bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True
_VALUE = mix(np.arange(0x110000, dtype=U64) + U64(0xA0761D6478BD642F))


def normalised(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters, document offsets, where in its document each character was) of lower-cased texts with single spaces and none at either end."""
    data, ends = text_buffers(column)
    bounds = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][ends]
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    space = _SPACE[chars]
    after = np.zeros(len(chars), bool)
    after[1:] = ~space[:-1]
    after[bounds[:-1][bounds[:-1] < len(chars)]] = False
    before = np.zeros(len(chars), bool)  # whether anything but space follows in the document
    last = np.flatnonzero(~space)
    if len(last):
        doc_end = np.repeat(bounds[1:], np.diff(bounds))
        at_or_after = np.searchsorted(last, np.arange(len(chars)))
        before = (at_or_after < len(last)) & (last[np.minimum(at_or_after, len(last) - 1)] < doc_end)
    keep = ~space | (after & before)
    at = np.flatnonzero(keep)
    out = np.where(space[at], np.uint32(32), _LOWER[chars[at]])
    offsets = np.searchsorted(at, bounds)
    return out, offsets, at - np.repeat(bounds[:-1], np.diff(offsets))


def _find(text: np.ndarray, wanted: np.ndarray) -> int:
    """Where ``wanted`` first occurs in ``text``, or -1."""
    raw, part, at = text.tobytes(), wanted.tobytes(), -1
    while (at := raw.find(part, at + 1)) >= 0:
        if not at % wanted.itemsize:
            return at // wanted.itemsize
    return -1


class Items:
    """q-grams of a benchmark: sorted hashes with the items and positions they come from."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.data, self.offsets, _ = normalised(pa.array(texts, pa.string()))
        self.ids = ids
        self.size = np.diff(self.offsets)
        self.edits = (RATE * self.size).astype(np.int64)
        self.bound = self.size + 1 - Q - self.edits * Q
        self.width = 2 * self.edits + 1
        grams = rolling(prefix(_VALUE[self.data]), Q)
        item = np.searchsorted(self.offsets, np.arange(len(grams)), "right") - 1
        at = np.arange(len(grams)) - self.offsets[item]
        ok = (at + Q <= self.size[item]) & (self.size[item] >= LEAST)
        order = np.argsort(grams[ok], kind="stable")
        self.grams, self.item, self.at = grams[ok][order], item[ok][order], at[ok][order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.grams >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    @cached_property
    def short(self):
        """Automaton of the items under LEAST characters, None without any. Built where it is used."""
        words: dict[str, list[int]] = {}
        for i in np.flatnonzero((self.size > 0) & (self.size < LEAST)).tolist():
            words.setdefault(self.text(i).tobytes().decode("utf-32-le"), []).append(i)
        if not words:
            return None
        automaton = ahocorasick.Automaton()
        for word, items in words.items():
            automaton.add_word(word, (len(word), items))
        automaton.make_automaton()
        return automaton

    def short_hits(self, data: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(edits, start, end) of the first place of each short item in each document."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {}
        if self.short is None:
            return out
        for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            text = data[a:b].tobytes().decode("utf-32-le")
            for end, (size, items) in self.short.iter(text) if text else ():
                start, end = end + 1 - size, end + 1
                if not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()):
                    for item in items:
                        out.setdefault((doc, item), (0, start, end))
        return out

    def text(self, item: int) -> np.ndarray:
        return self.data[self.offsets[item] : self.offsets[item + 1]]

    def bands(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first and last diagonal) of bands that hold enough shared q-grams. A diagonal is where the item would begin."""
        grams = rolling(prefix(_VALUE[data]), Q)
        at = np.flatnonzero(self.filter[(grams >> U64(64 - FILTER_BITS)).astype(np.int64)])
        low = np.searchsorted(self.grams, grams[at], "left")
        count = np.searchsorted(self.grams, grams[at], "right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[doc + 1]
        at, low, count, doc = at[inside], low[inside], count[inside], doc[inside]
        if not len(at):
            return []
        row = np.repeat(np.arange(len(at)), count)
        entry = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        item = self.item[entry]
        diagonal = at[row] - offsets[doc[row]] - self.at[entry]
        # Negative diagonals are shifted by a multiple of the width; a band is [b * width, (b + 2) * width).
        band = diagonal // self.width[item]
        doc = np.concatenate([doc[row], doc[row]])
        item, band = np.concatenate([item, item]), np.concatenate([band, band - 1])
        order = np.lexsort((band, item, doc))
        doc, item, band = doc[order], item[order], band[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        hits = np.diff(np.r_[first, len(doc)])
        enough = first[hits >= self.bound[item[first]]]
        w = self.width[item[enough]]
        return list(zip(doc[enough].tolist(), item[enough].tolist(), (band[enough] * w).tolist(), ((band[enough] + 2) * w - 1).tolist(), strict=True))


def align(item: np.ndarray, text: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """(least edits, end in ``text``) of ``item`` against any stretch of ``text`` that begins on a diagonal from ``first`` to ``last``.

    A row of the table is one character of the item; column d is diagonal first + d.
    """
    columns = last - first + 1
    far = len(item) + columns + 1
    steps = np.arange(columns)
    begin = first + steps
    row = np.where((begin >= 0) & (begin <= len(text)), 0, far)
    row = np.minimum.accumulate(row - steps) + steps
    padded = np.full(len(item) + columns + 1, -1, np.int64)
    low, high = max(0, first), min(len(text), first + len(padded))
    if low < high:
        padded[low - first : high - first] = text[low:high]
    for i, symbol in enumerate(item):
        follow = row + (padded[i : i + columns] != symbol)  # the next character of both
        skip = np.r_[row[1:], far] + 1  # a character of the item only
        row = np.minimum(follow, skip)
        row = np.minimum.accumulate(row - steps) + steps  # characters of the text only
        row[(begin + i + 1 > len(text)) | (begin + i + 1 < 0)] = far
    best = int(row.argmin())
    return int(row[best]), first + best + len(item)


def _leaks(items: Items, data: np.ndarray, offsets: np.ndarray):
    """(document, item, start, end, edits): of each document and item the stretch with the fewest edits; characters of the normalised text."""
    best = items.short_hits(data, offsets)
    for doc, item, first, last in items.bands(data, offsets):
        if best.get((doc, item), (1,))[0] == 0:
            continue
        text, wanted = data[offsets[doc] : offsets[doc + 1]], items.text(item)
        low = max(0, first)
        found = _find(text[low : last + len(wanted) + 1], wanted)
        if found >= 0:
            best[doc, item] = (0, low + found, low + found + len(wanted))
            continue
        edits, end = align(wanted, text, first, last)
        if edits <= items.edits[item] and edits < best.get((doc, item), (1 << 30,))[0]:
            k = int(items.edits[item])
            back = max(0, end - len(wanted) - k)
            _, size = align(wanted[::-1], text[back:end][::-1], 0, k)
            best[doc, item] = (edits, end - size, end)
    return [(d, i, s, e, n) for (d, i), (n, s, e) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame, item_bytes: int = ITEM_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, item_id, item_size, start, end, edits: every item that leaks into a document, with the best stretch as character positions of its text.

    ``carry`` names further columns of ``docs`` to keep.
    """
    spark = docs.sparkSession
    prepare(spark)
    total = benchmark.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    passes = -(-total // item_bytes) or 1
    columns = ["doc_id", *carry]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    item_kind = benchmark.schema["item_id"].dataType
    item_type = to_arrow_type(item_kind)
    out = None
    for n in range(passes):
        part = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n)
        rows = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id))  # about item_bytes
        shipped = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches, shipped=shipped):
            items = shipped.value
            for batch in slices(batches):
                data, offsets, at = normalised(batch.column("text"))
                found = _leaks(items, data, offsets)
                doc = np.array([f[0] for f in found], np.int64)
                start = [int(at[offsets[d] + s]) for d, _, s, _, _ in found]
                end = [int(at[offsets[d] + e - 1]) + 1 for d, _, _, e, _ in found]
                rows = [batch.column(c).take(pa.array(doc)) for c in columns]
                yield pa.RecordBatch.from_arrays([*rows, pa.array([items.ids[f[1]] for f in found], item_type), pa.array([int(items.size[f[1]]) for f in found], pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([f[4] for f in found], pa.int64())], [*columns, "item_id", "item_size", "start", "end", "edits"])

        leaks = docs.select(*columns, "text").mapInArrow(run, f"{kinds}, item_id {item_kind.simpleString()}, item_size long, start long, end long, edits long")
        out = leaks if out is None else out.unionByName(leaks)
    return out
