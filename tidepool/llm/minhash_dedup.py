"""MinHash near-duplicates: SuperMinHash signatures, banding, verification, union-find.

Documents with the same shingle set form a class, and one of each class goes on. Its SuperMinHash
signature (every element ranks all slots by its own permutation; a level of ranks is only looked at
while slots are open) is cut into bands, and classes that share a band meet in a bucket.

1. In every bucket the member with the most bucket mates overall is the centre; all others are
   verified against it on their full sets. A large group of copies thereby costs one check each.
2. Links found so far are joined into components. Where a bucket still spans several, its members are
   compared across components by signature, in blocks of bounded size, each pair in the first band that
   it shares. A bucket of any size is compared whole, as all pairs of its blocks. Members with a partner
   whose signature agrees come together once more with their texts, and full sets decide there: pairs
   are looked at within a block and never become rows.

A document with fewer words than a shingle has its whole word sequence as its only shingle; one
without words (null and empty texts) has none, stands alone and stays. Repeated rows fall in one
class. A null ``doc_id`` never names a component; a component of such rows only has a null name and
all its rows stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import components
from tidepool.llm.runtime import discard, prepare, stored
from tidepool.llm.textbuf import U64, Words, mix, prefix, slices, sort_within, span, text_buffers

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
#: Signature bytes that must agree for a verification in step 2; 96 of 128 agree on average at 75 %.
AGREE = 72
BLOCK, CHECKS = 512, 256
OPEN = U64((1 << 64) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all documents in turn, bounds of each document's stretch)."""
    words = Words(data, offsets)
    hashes = words.hashes(lower=True)
    at, shingles = words.windows(hashes, size)
    doc = words.doc[at]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = span(prefix(hashes), words.first[short], words.first[short + 1])
        doc = np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        doc, shingles = doc[order], np.concatenate([shingles, whole])[order]
    docs = len(offsets) - 1
    bounds = np.searchsorted(doc, np.arange(docs + 1))
    sort_within(shingles, bounds)
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (doc[1:] != doc[:-1])
    total = np.r_[0, np.cumsum(fresh)]
    return shingles[fresh], total[bounds]


def signatures(shingles: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of each document's set: slots of (level << 32 | rank); OPEN for empty sets.

    Slot s holds the least of level + rank over the elements that put s at that level of their own
    permutation. Levels are taken one at a time for all elements; a document is done once no slot is open.
    """
    docs = len(bounds) - 1
    out = np.full(docs * slots, OPEN, U64)
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    element = shingles
    lanes = np.arange(len(element))
    places = None  # what is left of each element's permutation, from level 1 on
    for level in range(slots):
        if not len(element):
            break
        h = mix(element + U64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
        pick = (level + (((h & U64(0xFFFFFFFF)) * U64(slots - level)) >> U64(32)).astype(np.int64)).astype(np.int64)
        if places is None:
            slot = pick
        else:
            slot = places[lanes, pick].astype(np.int64)
            places[lanes, pick] = places[lanes, level]
        np.minimum.at(out, doc * slots + slot, (h >> U64(32)) | U64(level << 32))
        still = (out.reshape(docs, slots) == OPEN).any(axis=1)[doc]
        if places is None:
            element, doc, pick = element[still], doc[still], pick[still]
            places = np.tile(np.arange(slots, dtype=np.uint8), (len(element), 1))
            places[np.arange(len(element)), pick] = 0
        elif still.mean() < 0.7:
            element, doc, places = element[still], doc[still], places[still]
        lanes = np.arange(len(element))
    return out.reshape(docs, slots)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key a band; it includes the band's number."""
    key = np.tile(mix(np.arange(1, BANDS + 1, dtype=U64)), (len(signature), 1))
    for r in range(ROWS):
        key = mix(key ^ signature[:, r::ROWS]) + U64(0x9E3779B97F4A7C15)
    return key


def set_digests(shingles: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that stand for a set: two sums of differently mixed elements. None for an empty set."""
    sums = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        run = np.zeros(len(shingles) + 1, U64)
        np.cumsum(mix(shingles ^ U64(salt)), out=run[1:])
        sums.append(mix(run[bounds[1:]] - run[bounds[:-1]] + np.diff(bounds).astype(U64)))
    both = np.ascontiguousarray(np.stack(sums, axis=1)).tobytes()
    return [both[16 * i : 16 * i + 16] if n else None for i, n in enumerate(np.diff(bounds).tolist())]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row that is never null; rows with one key are held apart by doc_id or by their sets."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))


def _sketch(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches, limit=1 << 20):
            shingles, bounds = shingle_sets(*text_buffers(batch.column("text")))
            signature = signatures(shingles, bounds)
            keys = band_keys(signature).view(np.int64)
            low = signature.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row_key"), pa.array(np.diff(bounds).astype(np.int64)), pa.array(set_digests(shingles, bounds), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * (len(keys) + 1), BANDS, dtype=np.int32)), pa.array(keys.ravel())), pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                ["doc_id", "row_key", "n_shingles", "set_digest", "bands", "sketch"],
            )

    return _keyed(docs).select("doc_id", "row_key", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key long, n_shingles long, set_digest binary, bands array<long>, sketch binary")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among ``pairs`` (a, b) of set digests: those whose full sets are similar enough.

    ``a`` is the side that repeats. Members are dealt out by (a, share), about CHECKS to a share, behind one row of a's text.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHECKS).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    members = dealt.join(texts.withColumnRenamed("set_digest", "b"), "b").select("a", "share", F.lit(1).alias("role"), "b", "text")
    centres = dealt.select("a", "share").distinct().join(texts.withColumnRenamed("set_digest", "a"), "a").select("a", "share", F.lit(0).alias("role"), F.col("a").alias("b"), "text")

    def run(batches):
        now, centre = None, np.empty(0, U64)
        for batch in slices(batches):
            shingles, bounds = shingle_sets(*text_buffers(batch.column("text")))
            made = set_digests(shingles, bounds)
            a, b, role = (batch.column(c).to_pylist() for c in ("a", "b", "role"))
            left, right = [], []
            for i in range(len(a)):
                if made[i] != b[i]:  # another row's text, met by a row key that is not unique
                    continue
                own = shingles[bounds[i] : bounds[i + 1]]
                if not role[i]:
                    now, centre = a[i], own
                elif now == a[i] and 100 * min(len(own), len(centre)) >= PERCENT * max(len(own), len(centre)):
                    few, many = sorted((own, centre), key=len)
                    same = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                    if 100 * same >= PERCENT * (len(own) + len(centre) - same):
                        left.append(a[i])
                        right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return members.union(centres).repartition("a", "share").sortWithinPartitions("a", "share", "role").mapInArrow(run, "a binary, b binary")


def _cells(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """Members of buckets (band, number, set_digest, root) with what ``_pairs`` needs, once for each pair of blocks that theirs is in."""
    sized = members.join(members.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "band").withColumn("block", F.pmod(F.xxhash64("set_digest"), F.col("blocks")))
    spread = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    return spread.select("band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "number", "set_digest", "root").join(sketches, "set_digest")


def _pairs(frame: pd.DataFrame, agree: int):
    """Positions (i, j) in one cell that lie in different components, whose sketches agree, and whose first shared band is ``number``."""
    sketch = np.frombuffer(b"".join(frame.sketch), np.uint8).reshape(len(frame), SLOTS)
    bands, root, block, number = np.stack(frame.bands.to_numpy()), frame.root.to_numpy(), frame.block.to_numpy(), int(frame.number.iloc[0])
    crossing = frame.low.iloc[0] != frame.high.iloc[0]
    for i in range(len(frame) - 1):
        near = np.flatnonzero((sketch[i + 1 :] == sketch[i]).sum(axis=1) >= agree) + i + 1
        near = near[(root[near] != root[i]) & ((block[near] != block[i]) | (not crossing))]
        if len(near):
            same = bands[near] == bands[i]
            near = near[same[:, number] & ~same[:, :number].any(axis=1)]
            if len(near):
                yield i, near


def _linked(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between different components within the cells, decided on full sets."""
    agree = AGREE

    def partners(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(frame), bool)
        for i, near in _pairs(frame, agree):
            hit[i] = True
            hit[near] = True
        return frame[hit][["band", "low", "high", "block", "number", "set_digest", "root", "sketch", "bands"]]

    def links(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        shingles, bounds = shingle_sets(*text_buffers(pa.array(frame.text, pa.string())))
        made, digest = set_digests(shingles, bounds), frame.set_digest.tolist()
        frame = frame[[m == bytes(d) for m, d in zip(made, digest, strict=True)]]
        sets = {bytes(d): shingles[a:b] for d, a, b in zip(digest, bounds[:-1], bounds[1:], strict=True)}
        frame = frame.drop_duplicates("set_digest")
        digest, root = frame.set_digest.tolist(), frame.root.tolist()
        up: dict = {}

        def find(x):
            while x in up:
                x = up[x]
            return x

        out = []
        for i, near in _pairs(frame, agree) if len(frame) else ():
            own = sets[bytes(digest[i])]
            for j in near.tolist():
                other = sets[bytes(digest[j])]
                if 100 * min(len(own), len(other)) < PERCENT * max(len(own), len(other)):
                    continue
                a, b = find(root[i]), find(root[j])
                if a == b:
                    continue
                few, many = (own, other) if len(own) < len(other) else (other, own)
                same = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
                if 100 * same >= PERCENT * (len(own) + len(other) - same):
                    out.append((digest[i], digest[j]))
                    up[a] = b
        return pd.DataFrame(out, columns=["a", "b"])

    met = stored(cells.groupBy("band", "low", "high").applyInPandas(partners, cells.select("band", "low", "high", "block", "number", "set_digest", "root", "sketch", "bands").schema))
    return met.join(texts, "set_digest").groupBy("band", "low", "high").applyInPandas(links, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    rows = stored(_sketch(docs))
    classes = rows.where(F.col("set_digest").isNotNull()).groupBy("set_digest").agg(F.min("row_key").alias("row_key"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(classes)
    bands = classes.select("set_digest", F.posexplode("bands").alias("number", "band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("mates")).where("mates > 1")
    buckets = stored(bands.join(shared, "band"))

    met = classes.join(buckets.select("set_digest").distinct(), "set_digest").select("set_digest", "row_key")
    keyed = _keyed(docs)
    # The same join at every size: a broadcast would only serve small tables.
    texts = stored(keyed.join(met.hint("merge"), "row_key").select("set_digest", "text"))

    mates = buckets.groupBy("set_digest").agg(F.sum("mates").alias("all_mates"))
    centres = buckets.join(mates, "set_digest").groupBy("band").agg(F.max(F.struct("all_mates", "set_digest")).alias("top")).select("band", F.col("top.set_digest").alias("centre"))
    stars = stored(buckets.join(centres, "band").select("band", "number", "set_digest", "centre", "mates"))
    pairs = stars.where("set_digest <> centre").select(F.col("centre").alias("a"), F.col("set_digest").alias("b")).distinct()
    links = stored(_verified(pairs, texts))
    discard(buckets)
    roots = components(links)

    # Step 2: all but the centres, where they still belong to several components.
    rest = stars.where("mates > 2 and set_digest <> centre").select("band", "number", "set_digest").join(roots.withColumnRenamed("node", "set_digest"), "set_digest", "left").withColumn("root", F.coalesce("root", "set_digest"))
    rest = stored(_several(rest))
    if not rest.isEmpty():
        more = stored(_linked(_cells(rest, classes.select("set_digest", "sketch", "bands")), texts))
        if not more.isEmpty():
            roots = components(links.union(more))

    rooted = rows.select("doc_id", "row_key", "n_shingles", "set_digest").join(roots.withColumnRenamed("node", "set_digest"), "set_digest", "left").withColumn("root", F.coalesce("root", "set_digest"))
    rooted = stored(rooted)
    discard(rows, classes, texts, stars, links)
    names = rooted.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("name"))
    out = rooted.join(names, "root", "left").withColumn("component_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("name")))
    return out.select("doc_id", "row_key", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _several(members: DataFrame) -> DataFrame:
    """Members of buckets that still span more than one component."""
    spans = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    return members.join(spans, "band")


