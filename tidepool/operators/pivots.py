"""The nearest vectors of many queries through pivots: exact, and without comparing what the triangle inequality rules out.

Angles between vectors are distances. Each vector lies in the cluster of its nearest pivot and there in a ring of equal
angles to it. A query first searches the cluster of its own nearest pivot; the angle to its ``k``-th best there then rules
out every ring whose angles to a pivot differ by more from the query's angle to it. What is left is compared in blocks.

Pivots are a sample of PIVOTS vectors of each length, which is all that tasks are sent; every vector is indexed, and the
result doesn't depend on the sample. Vectors that are null, empty or all zeros, and those of other lengths than the query, have
no angle to it: they are never found, so that a query may find fewer than ``k``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.ranking import top_per
from tidepool.runtime import cut

#: Pivots at most; vectors that a pivot or a ring stands for, and vectors and queries of one comparison, as a rule.
PIVOTS, SHARE, ROWS, QUERIES = 64, 512, 2048, 256
#: Similarities are rounded to six places; this much more angle still ties. Near equal vectors the angle changes fastest.
SLACK = 2e-3


def unit(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy()).astype(float)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def proper(vectors: DataFrame, name: str) -> DataFrame:
    """Rows whose vector has an angle to others."""
    return vectors.where(F.aggregate(F.coalesce(name, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x * x) > 0)


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    sizes = vectors.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows"))
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(F.col("rows") / SHARE)))
    first = top_per(vectors.join(sizes, F.size("embedding") == F.col("n")).select("id", "embedding", "n", wanted.alias("wanted")), "n", PIVOTS, F.xxhash64("id"), F.col("id")).where("rank <= wanted")
    held: dict[int, list] = {}
    for r in first.toLocalIterator():
        held.setdefault(r.n, []).append(r.embedding)
    return {n: unit(pd.Series(rows)) for n, rows in held.items()}


def _placed(pivots: dict[int, np.ndarray]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, group in frame.groupby(frame.embedding.map(len)):
                far = angles(unit(group.embedding), pivots[n])
                cluster = far.argmin(axis=1)
                yield pd.DataFrame({"id": group.id.to_numpy(), "embedding": group.embedding.to_numpy(), "size": n, "cluster": cluster, "angle": far[np.arange(len(far)), cluster]})

    return run


def _aimed(pivots: dict[int, np.ndarray]):
    """Each query with the cluster of its nearest pivot and its angles to all."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for n, group in frame.groupby(frame.asked.map(len)):
                if n in pivots:
                    far = angles(unit(group.asked), pivots[n])
                    yield pd.DataFrame({"asked_id": group.asked_id.to_numpy(), "asked": group.asked.to_numpy(), "size": n, "own": far.argmin(axis=1), "far": list(far)})

    return run


FOUND = "asked_id long, id long, similarity double, compared long"


def _compared(k: int):
    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"asked_id": [None], "id": [None], "similarity": [None], "compared": [len(asked) * len(held)]}, dtype=object)]
        if len(asked) and len(held):
            sim, ids = np.round(unit(asked.asked) @ unit(held.embedding).T, 6), held.id.to_numpy()
            for row, name in zip(sim, asked.asked_id.to_numpy(), strict=True):
                at = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k])
                at = at[np.lexsort((ids[at], -row[at]))][:k]
                out.append(pd.DataFrame({"asked_id": name, "id": ids[at], "similarity": row[at], "compared": 0}, dtype=object))
        return pd.concat(out)

    return run


def compared(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """FOUND: what can be among the ``k`` nearest of each query, and rows without ids with how many pairs a cell compared."""
    vectors = cut(proper(vectors.select("id", "embedding"), "embedding"))
    pivots = _pivots(vectors)
    held = vectors.mapInPandas(_placed(pivots), "id long, embedding array<double>, size int, cluster int, angle double")
    held = cut(held)
    clusters = held.groupBy("size", "cluster").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.greatest(F.lit(1), F.floor(F.count("*") / SHARE)).alias("rings"))
    clusters = clusters.withColumn("width", (F.col("high") - F.col("low")) / F.col("rings") + 1e-9)
    held = held.join(clusters, ["size", "cluster"]).withColumn("ring", F.floor((F.col("angle") - F.col("low")) / F.col("width")).cast("int"))
    rings = held.groupBy("size", "cluster", "ring").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    rings = cut(rings)
    held = cut(held.select("id", "embedding", "size", "cluster", "ring").join(rings.select("size", "cluster", "ring", "blocks"), ["size", "cluster", "ring"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")))
    aimed = proper(queries.select("asked_id", "asked"), "asked").mapInPandas(_aimed(pivots), "asked_id long, asked array<double>, size int, own int, far array<double>")
    aimed = cut(aimed)
    aimed = aimed.withColumn("group", F.pmod(F.xxhash64("asked_id"), F.lit(max(1, -(-aimed.count() // QUERIES)))).cast("int"))

    def met(wanted: DataFrame) -> DataFrame:
        """``wanted`` (asked_id, asked, group, size, cluster, ring, blocks) compared with the rings that they name."""
        keys = ["size", "cluster", "ring", "block", "group"]
        left = wanted.select("asked_id", "asked", *[F.col(c).alias(c) for c in ("size", "cluster", "ring", "group")], F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        asking = left.select(*keys).distinct()
        right = held.join(asking, keys[:-1]).select("id", "embedding", *[F.col(c).alias(c) for c in keys])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compared(k), FOUND)

    first = cut(met(aimed.join(rings, (aimed["size"] == rings["size"]) & (aimed.own == rings.cluster)).select("asked_id", "asked", "group", rings["size"], "cluster", "ring", "blocks")))
    best = top_per(first.where("asked_id IS NOT NULL"), "asked_id", k, F.desc("similarity"))
    bar = best.groupBy("asked_id").agg(F.min("similarity").alias("bar"), F.count("*").alias("n")).where(F.col("n") >= k)
    reach = F.coalesce(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("bar")))) + SLACK, F.lit(4.0))
    later = aimed.join(bar, "asked_id", "left").withColumn("reach", reach).join(rings.withColumnRenamed("size", "n_dims"), F.col("size") == F.col("n_dims"))
    angle = F.get("far", F.col("cluster"))
    within = (angle - F.col("reach") <= F.col("most")) & (angle + F.col("reach") >= F.col("least"))
    return first.unionByName(met(later.where(within & (F.col("cluster") != F.col("own"))).select("asked_id", "asked", "group", "size", "cluster", "ring", "blocks")))


def nearest_by_pivots(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(asked_id, id, similarity) of the ``k`` vectors (id, embedding) most similar to each of ``queries`` (asked_id, asked), over all vectors; ties go by id."""
    found = compared(vectors, queries, k).where("asked_id IS NOT NULL").select("asked_id", "id", "similarity")
    return top_per(found, "asked_id", k, F.desc("similarity"), F.col("id")).drop("rank")
