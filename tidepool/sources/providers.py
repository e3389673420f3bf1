"""Models behind a small interface: what they answer is theirs, how they are called and what is kept is ours."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import content_hash

#: How much of a text each kind of call sends.
INPUT_LIMIT = {"embed": 2000, "compress": 3000, "merge": 2000, "tag": 2000, "split": 5000, "extract": 12000, "evaluate": 2000}


class Provider(Protocol):
    def complete(self, texts: list[str]) -> list[str]:
        """One answer a text, in order."""


class FirstWords:
    """A deterministic provider for tests: the first words of a text."""

    def __init__(self, words: int = 8):
        self.words = words

    def complete(self, texts: list[str]) -> list[str]:
        return [" ".join(t.split()[: self.words]) for t in texts]


def hashed_vector(text: str, size: int = 64) -> list[float]:
    """A deterministic embedding for tests: signed counts of hashed words, scaled to length 1."""
    v = [0.0] * size
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % size] += 1.0 if h >> 63 else -1.0
    norm = sum(x * x for x in v) ** 0.5
    return [x / norm for x in v] if norm else v


class HashedVectors:
    """A deterministic provider of embeddings for tests: each as a JSON list."""

    def complete(self, texts: list[str]) -> list[str]:
        return [json.dumps(hashed_vector(t)) for t in texts]


def answered(rows: DataFrame, make: Callable[[], Provider], kind: str, column: str = "text", batch: int = 20) -> DataFrame:
    """``rows`` with (answer, error): one client a partition, ``batch`` texts a call, one retry text by text so that a bad one fails alone."""
    limit = INPUT_LIMIT[kind]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            texts, answers, errors = [(t or "")[:limit] for t in frame[column]], [], []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                try:
                    got = client.complete(part)
                    answers += got
                    errors += [None] * len(part)
                except Exception:  # noqa: BLE001
                    for t in part:
                        try:
                            answers.append(client.complete([t])[0])
                            errors.append(None)
                        except Exception as e:  # noqa: BLE001
                            answers.append(None)
                            errors.append(f"{type(e).__name__}: {e}"[:200])
            yield frame.assign(answer=answers, error=errors)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, answer string, error string")


def memoised(rows: DataFrame, cache: DataFrame, make: Callable[[], Provider], kind: str, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with answers, new cache entries): texts whose hash the cache (content_hash, answer) holds aren't sent, equal texts are sent once."""
    hashed = rows.withColumn("content_hash", content_hash(F.coalesce(column, F.lit(""))))
    misses = hashed.select("content_hash", column).join(cache, "content_hash", "left_anti").groupBy("content_hash").agg(F.first(column).alias(column))
    made = answered(misses, make, kind, column).select("content_hash", "answer", "error")
    known = cache.select("content_hash", "answer", F.lit(None).cast("string").alias("error")).unionByName(made)
    return hashed.join(known, "content_hash", "left"), made.where("error IS NULL").select("content_hash", "answer")


def backfilled(memory: DataFrame, vectors: DataFrame, make: Callable[[], Provider]) -> DataFrame:
    """(id, embedding, outcome) of memories without a vector: blank texts are skipped, others succeed or fail by what the model answers (a JSON list of numbers)."""
    missing = memory.select("id", F.col("content").alias("text")).join(vectors.select("id"), "id", "left_anti")
    blank = F.coalesce(F.col("text"), F.lit("")).rlike(r"^\s*$")
    made = answered(missing.where(~blank), make, "embed").withColumn("embedding", F.from_json("answer", "array<double>"))
    good = F.coalesce(F.size("embedding") > 0, F.lit(False)) & ~F.coalesce(F.exists("embedding", lambda x: x.isNull()), F.lit(False))
    rows = made.select("id", F.when(good, F.col("embedding")).alias("embedding"), F.when(good, "success").otherwise("failed").alias("outcome"))
    return rows.unionByName(missing.where(blank).select("id", F.lit(None).cast("array<double>").alias("embedding"), F.lit("skipped").alias("outcome")))


def backfill_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("success", "failed", "skipped")])
