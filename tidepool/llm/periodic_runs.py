"""Periodic runs of words: stretches that repeat a phrase several times over, found by Gusfield and Stoye's method.

Only stretches can hold a run in which each word occurred at most one period before; a scan by powers of two finds
them all. They are put behind each other with separators that occur once, and of that string

* doubled ranks give the suffix order, equality of any two stretches, and longest common extensions both ways;
* its Lempel-Ziv blocks give, by one extension each way from the borders of a block, squares that cover the leftmost
  occurrence of every square;
* walks along suffix links from these, over the suffix tree as it lies in the suffix order (a node is an interval, a
  child is found by its letter), complete the vocabulary of primitively rooted squares;
* all occurrences of the vocabulary, which lie together in the suffix order, merge into runs.

All steps go over whole arrays. Null texts count as empty. Rows are independent of each other: repeated rows and ids,
and ids that are null, each give a row; other columns are not kept, and an empty table gives none. A text is held whole
by a task, with about a hundred bytes for each of its words that lies in such a stretch, and four more for each doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.runtime import prepare
from tidepool.llm.textbuf import Words, joined_words, ranges, release, slices, text_buffers

#: Queries for extensions answered at a time.
ASKED = 1 << 19


def word_codes(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words."""
    sizes = words.ends - words.starts
    held = words.data[ranges(words.starts, words.ends)]
    column = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(held)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def suspects(codes: np.ndarray, doc: np.ndarray, first: np.ndarray, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of stretches outside which no run lies, apart from each other and within documents.

    Past its first period q, each word of a run occurred at most q words before. For q up to 2^k and over half of it,
    the rest of the run is a stretch of words whose last occurrence is at most 2^k back.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    same = (codes[order[1:]] == codes[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    back = np.full(n, n + 1)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    inside = np.zeros(n + 1, np.int32)
    longest = int(np.diff(first).max(initial=0))
    power, lower = 1, 1  # periods from lower to power
    while lower * exponent <= longest:
        edge = np.diff(np.r_[False, back <= power, False].astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = ends - starts >= max((exponent - 1) * lower, least - power)
        starts, ends = starts[long], ends[long]
        np.add.at(inside, np.maximum(starts - power, first[doc[starts]]), 1)
        np.subtract.at(inside, ends, 1)
        lower, power = power + 1, power * 2
    held = np.cumsum(inside[:-1]) > 0
    opens = held & np.r_[True, ~held[:-1] | (doc[1:] != doc[:-1])] if n else held
    closes = held & np.r_[~held[1:] | (doc[1:] != doc[:-1]), True] if n else held
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


class Suffixes:
    """The suffixes of a string of numbers in order, and what equals what in it.

    ``ranks[l][i]`` is the place of the first suffix that starts with the same 2^l letters as suffix i does.
    """

    def __init__(self, text: np.ndarray):
        self.n = n = len(text)
        _, letter = np.unique(text, return_inverse=True)
        key, self.ranks, self.sizes = letter.astype(np.int64), [], []
        while True:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.r_[True, ordered[1:] != ordered[:-1]]
            at = np.flatnonzero(new)
            rank = np.full(n + 1, -1, np.int32)
            rank[order] = np.repeat(at, np.diff(np.r_[at, n]))
            self.ranks.append(rank)
            if len(at) == n:
                break
            step = 1 << (len(self.ranks) - 1)
            follows = np.full(n, -1, np.int64)
            follows[: max(0, n - step)] = rank[step:n]
            key = rank[:n].astype(np.int64) * (n + 2) + follows + 1
        self.order, self.place = order, self.ranks[-1]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters from i and from j on are equal, for i and j that differ."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[level]
            step = (rank[i] == rank[j]).astype(np.int64) << level
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many letters before i and before j are equal."""
        i, j, start = i.copy(), j.copy(), i
        for level in range(len(self.ranks) - 1, -1, -1):
            rank, a, b = self.ranks[level], i - (1 << level), j - (1 << level)
            step = ((np.minimum(a, b) >= 0) & (rank[np.maximum(a, 0)] == rank[np.maximum(b, 0)])).astype(np.int64) << level
            i -= step
            j -= step
        return start - i

    def interval(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) in the suffix order of the suffixes that start with the ``size`` letters at ``at``: a place in the suffix tree."""
        low, high = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        levels = np.frexp(size.astype(float))[1] - 1
        for level in np.unique(levels).tolist():
            which = np.flatnonzero(levels == level)
            rank, pos, shift = self.ranks[level] if level < len(self.ranks) else self.place, at[which], size[which] - (1 << level)
            if level >= len(self.ranks):  # longer than anything that occurs twice
                low[which], high[which] = self.place[pos], self.place[pos] + 1
                continue
            want, here = rank[pos + shift], self.place[pos].astype(np.int64)
            while level >= len(self.sizes):
                self.sizes.append(np.bincount(self.ranks[len(self.sizes)][: self.n], minlength=self.n))
            a, b = rank[pos].astype(np.int64), here.copy()  # the first that agrees is in [a, b]
            c, d = here.copy(), rank[pos] + self.sizes[level][rank[pos]] - 1  # the last that agrees is in [c, d]
            while ((a < b) | (c < d)).any():
                m = (a + b) // 2
                agrees = rank[self.order[m] + shift] == want
                a, b = np.where((a < b) & ~agrees, m + 1, a), np.where((a < b) & agrees, m, b)
                m = (c + d + 1) // 2
                agrees = rank[self.order[m] + shift] == want
                c, d = np.where((c < d) & agrees, m, c), np.where((c < d) & ~agrees, m - 1, d)
            low[which], high[which] = a, c + 1
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, like: np.ndarray) -> np.ndarray:
        """A position whose suffix starts with the ``size`` letters of an interval and then the letter at ``like``; -1 if none does."""
        letter = self.ranks[0]
        want, a, b = letter[like], low.copy(), high.copy()
        while (a < b).any():
            m = np.minimum((a + b) // 2, self.n - 1)
            less = letter[np.minimum(self.order[m] + size, self.n)] < want
            a, b = np.where((a < b) & less, m + 1, a), np.where((a < b) & ~less, m, b)
        found = self.order[np.minimum(a, self.n - 1)]
        return np.where((a < high) & (letter[np.minimum(found + size, self.n)] == want), found, -1)


def blocks(s: Suffixes) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is the longest stretch from there that also starts earlier, or one new letter."""
    before, after, open_ = [-1] * s.n, [-1] * s.n, []
    for i in s.order.tolist():  # the nearest in the suffix order, on both sides, that start earlier in the text
        while open_ and open_[-1] > i:
            after[open_.pop()] = i
        if open_:
            before[i] = open_[-1]
        open_.append(i)
    here, size = np.arange(s.n), np.ones(s.n, np.int64)
    for other in (np.array(before, np.int64), np.array(after, np.int64)):
        has = np.flatnonzero(other >= 0)
        size[has] = np.maximum(size[has], s.ahead(here[has], other[has]))
    starts, at, sizes = [], 0, size.tolist()
    while at < s.n:
        starts.append(at)
        at += sizes[at]
    return np.array(starts, np.int64)


def primitive(s: Suffixes, at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the k letters at ``at`` are no repetition of fewer."""
    out, rest, p = np.ones(len(at), bool), k.copy(), 2
    while len(live := np.flatnonzero(rest > 1)):
        big = p * p > rest[live]
        for which, prime in ((live[big], rest[live[big]]), (live[~big], np.full(int((~big).sum()), p))):
            which, prime = which[rest[which] % prime == 0], prime[rest[which] % prime == 0]
            part = k[which] // prime
            out[which] &= s.ahead(at[which], at[which] + part) < k[which] - part
            rest[which] //= prime
        rest[live[big]] = 1
        if not big.all() and not (rest[live] % p == 0).any():
            p += 1
    return out


def covering(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(start, k) of primitively rooted squares of twice k letters, from which steps to the right cover the leftmost of each kind."""
    low = blocks(s)
    end, beyond = np.r_[low[1:], s.n], np.r_[low[2:], s.n, s.n][: len(low)]
    asked = []
    for base, most in ((end, end - low), (low, beyond - low)):  # from the block's end to the left, from its start to the right
        k = ranges(np.ones(len(low), np.int64), most + 1)
        asked.append((np.repeat(base, most), k, np.repeat(end, most)))
    out = []
    for left, (base, k, last) in zip((True, False), asked, strict=True):
        for i in range(0, len(k), ASKED):
            b, n, e = base[i : i + ASKED], k[i : i + ASKED], last[i : i + ASKED]
            other = b - n if left else b + n
            ok = (other >= 0) & (other < s.n) & (b < s.n)
            b, n, e, other = b[ok], n[ok], e[ok], other[ok]
            right, back = s.ahead(b, other), s.behind(b, other)
            first = np.minimum(b, other)
            start = np.maximum(first - back, first - n + 1)
            good = (right + back >= n) & (right > 0)
            if not left:
                good &= (back > 0) & (start + n <= e)
            out.append((start[good], n[good]))
    start, k = (np.concatenate(x) for x in zip(*out, strict=True))
    _, once = np.unique(start * (s.n + 1) + k, return_index=True)
    start, k = start[once], k[once]
    own = primitive(s, start, k)
    return start[own], k[own]


def vocabulary(s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, high, k): each primitively rooted square once, as an interval of the suffix order."""
    at, k = covering(s)
    left, seen, found = k.copy(), np.empty(0, np.int64), []
    while len(at):
        # Along a run, a suffix link and the letter that follows lead from one square to the next.
        steps = np.minimum(k + s.ahead(at, at + k) - 2 * k + 1, left)
        wide, pos = np.repeat(k, steps), ranges(at, at + steps)
        low, high = s.interval(pos, 2 * wide)
        key = low * (s.n + 1) + wide
        heads = np.r_[0, np.cumsum(steps)[:-1]]
        fresh = ~np.isin(key[heads], seen)
        key, once = np.unique(key, return_index=True)
        new = ~np.isin(key, seen)
        found.append((low[once][new], high[once][new], wide[once][new]))
        seen = np.union1d(seen, key)
        # Beyond it, the link leads to the square without its first letter; the letter may follow at another place.
        left = left - steps
        go = np.flatnonzero(fresh & (left > 0))
        last, k, left = (at + steps - 1)[go], k[go], left[go]
        low, high = s.interval(last + 1, 2 * k - 1)
        at = s.child(low, high, 2 * k - 1, last)
        k, left, at = k[at >= 0], left[at >= 0], at[at >= 0]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


def runs_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of at least two periods in a string of numbers."""
    if not len(text):
        return (np.empty(0, np.int64),) * 3
    s = Suffixes(text)
    low, high, k = vocabulary(s)
    if not len(k):
        return low, high, k
    pos, wide = s.order[ranges(low, high)], np.repeat(k, high - low)
    order = np.lexsort((pos, wide))
    pos, wide = pos[order], wide[order]
    opens = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1] + 1) | (wide[1:] != wide[:-1])])
    closes = np.r_[opens[1:], len(pos)] - 1
    return pos[opens], pos[closes] + 2 * wide[opens], wide[opens]


def word_runs(words: Words, exponent: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of a batch's words with at least ``exponent`` periods and ``least`` words, by start and period."""
    codes = word_codes(words)
    a, b = suspects(codes, words.doc, words.first, exponent, least)
    size = b - a + 1  # with a separator
    text = np.empty(int(size.sum()), np.int64)
    cut = np.cumsum(size)
    where = ranges(a, b + 1)
    text[:] = codes[np.minimum(where, max(0, len(codes) - 1))]
    text[cut - 1] = -1 - np.arange(len(cut))
    start, end, period = runs_of(text)
    keep = end - start >= np.maximum(exponent * period, least)
    start, end, period = where[start[keep]], where[end[keep] - 1] + 1, period[keep]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def collapse_runs(docs: DataFrame, exponent: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), collapsed (the words outside of repeats, joined by one space).

    A run is a stretch whose words agree at distance ``period``, the smallest such, that no neighbouring word continues, and
    that holds at least ``exponent`` (two or more) periods and ``least`` words. Its words after the first period are repeats.
    """
    if exponent < 2:
        raise ValueError("a run holds at least two periods")
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [pa.field(x, pa.int64()) for x in ("start", "length", "period")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(*text_buffers(batch.column("text")))
            start, end, period = word_runs(words, exponent, least)
            change = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.subtract.at(change, end, 1)
            owner = words.doc[start]
            flat = pa.StructArray.from_arrays([pa.array(start - words.first[owner]), pa.array(end - start), pa.array(period)], fields=fields)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.count.astype(np.int64)), lists, joined_words(words, np.cumsum(change[:-1]) > 0)], ["doc_id", "n_words", "runs", "collapsed"])
        release()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
