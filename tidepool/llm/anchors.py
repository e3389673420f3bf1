"""Anchors: the few positions of a sequence by which equal stretches find each other.

Every window of a fixed length owns one anchor, the k-gram of least hash inside it, so equal windows
own equal anchors at the same offset. Windows that follow one another mostly share their anchor; they
are one *occurrence*. Only anchors that occur in several places can belong to windows that do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.textbuf import U64, mix

CHUNK = 1 << 20
_POS = U64((1 << 24) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if w > size else out


def occurrences(grams: np.ndarray, k: int, window: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor hash, anchor position, first window, last window) of each occurrence.

    ``grams`` are the hashes of all k-grams of the joined sequence, ``offsets`` its document bounds.
    The leftmost of equal hashes is the anchor, in every document alike.
    """
    w, n = window - k + 1, int(offsets[-1])
    starts = np.flatnonzero(np.diff(offsets) >= window)
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none.astype(U64), none, none, none
    fits = np.zeros(n + 1, np.int32)
    fits[offsets[starts]] += 1
    np.subtract.at(fits, offsets[starts + 1] - window + 1, 1)
    fits = np.cumsum(fits[:n]) > 0
    owner = np.empty(n - window + 1, np.int64)
    for c in range(0, len(owner), CHUNK):
        part = grams[c : min(c + CHUNK + w - 1, len(grams))]
        key = (part & ~_POS) | np.arange(len(part), dtype=U64)
        least = _sliding_min(key, w)[:CHUNK]
        owner[c : c + len(least)] = (least & _POS).astype(np.int64) + c
    at = np.flatnonzero(fits[: len(owner)])
    own = owner[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(at)] - 1
    doc = np.searchsorted(offsets, at[first], "right") - 1
    return doc, mix(grams[own[first]] ^ U64(0x452821E638D01377)), own[first], at[first], at[last]


def exact_copies(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``carry``, text and two hashes (t1, t2) of the text; rows with both equal hold the same text. Null texts count as empty."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", *carry, text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def repeated(anchors: DataFrame) -> DataFrame:
    """(t1, t2, anchors) of the texts that hold anchors occurring elsewhere too.

    ``anchors`` has (t1, t2, anchor, multi): one row a text and anchor; ``multi`` if the text alone makes it repeated.
    """
    least = anchors.groupBy("anchor").agg(*(f(c).alias(f.__name__ + c) for c in ("t1", "t2") for f in (F.min, F.max)), F.max("multi").alias("multi"))
    several = least.where("mint1 <> maxt1 OR mint2 <> maxt2 OR multi").select("anchor")
    return anchors.select("t1", "t2", "anchor").join(several, "anchor", "left_semi").groupBy("t1", "t2").agg(F.collect_set("anchor").alias("anchors"))


def members(values: np.ndarray, wanted: list[np.ndarray], doc: np.ndarray, docs: int) -> np.ndarray:
    """Mask of the ``values`` that their own document's list holds."""
    out = np.zeros(len(values), bool)
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    for d in range(docs):
        a, b = bounds[d], bounds[d + 1]
        if a < b and len(wanted[d]):
            out[a:b] = np.isin(values[a:b], wanted[d])
    return out


def lists(column: pa.ListArray) -> list[np.ndarray]:
    """An Arrow column of long lists as numpy arrays."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    offsets = offsets - offsets[0]
    return [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def once_each(owner: np.ndarray, *content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first of each, order, bounds) of rows that agree in ``owner`` and ``content``: group g is ``order[bounds[g]:bounds[g + 1]]``.

    Text that repeats a few words has an occurrence at every repeat; a document then sends each content once, with all its places.
    """
    order = np.lexsort((*content, owner))
    fresh = np.ones(len(order), bool)
    for x in (owner, *content):
        same = x[order[1:]] == x[order[:-1]]
        fresh[1:] = same if x is owner else fresh[1:] & same
    fresh[1:] = ~fresh[1:]
    cut = np.flatnonzero(fresh)
    return order[cut], order, np.r_[cut, len(order)]


def place_lists(places: np.ndarray, order: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(places[order].astype(np.int64)))


def pieces(batch: pa.RecordBatch, limit: int = 400_000):
    """The rows of a batch in parts that hold about ``limit`` places once each of their windows has its own."""
    weight = np.diff(batch.column("places").offsets.to_numpy()).astype(np.int64) * batch.column("windows").to_numpy()
    group = (np.cumsum(weight) - weight // 2) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)
