"""Connected components of a graph given as edges, without gathering it anywhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.runtime import discard, stored

MAX_ROUNDS = 60


def _forest(edges: DataFrame) -> DataFrame:
    """Union-find over each partition's edges: an edge from every node to the least of its set."""

    def run(frames):
        parent: dict = {}

        def find(x):
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while (up := parent[x]) != root:
                parent[x], x = root, up
            return root

        for frame in frames:
            for u, v in zip(frame.u, frame.v, strict=True):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        for i in range(0, len(pairs), 50_000):
            yield pd.DataFrame(pairs[i : i + 50_000], columns=["u", "v"])

    return edges.mapInPandas(run, edges.schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in ``edges`` (a, b); the root is the least node of the component.

    A union-find within each partition comes first; large-star and small-star rounds then join the
    trees until every edge leads from a node to a root. Self-edges don't matter.
    """
    e = stored(_forest(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()))
    for _ in range(MAX_ROUNDS):
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large)
        discard(e)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(large)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
