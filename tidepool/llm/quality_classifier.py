"""Quality classifier: supervised subword embeddings.

Hashed words and character n-grams have learned vectors; a document is their average, and a softmax layer
turns it into class probabilities. Training is stochastic gradient descent in numpy over a bounded
sample of labelled rows. As averages and the layer are linear, scoring needs one number a bucket.

Null and empty texts get the score of the layer's bias alone. A null ``doc_id`` is carried through
and never learned from; repeated rows are scored one by one, further columns don't matter. With labels of one class only, or none,
the score is that class's smoothed share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidepool.llm.ngrams import SAMPLE, Buckets, Shares, sample_columns
from tidepool.llm.quality_rules import labelled_sample
from tidepool.llm.runtime import prepare
from tidepool.llm.textbuf import release, slices, text_buffers

#: Labelled documents learned from at most, chosen by a hash of doc_id.
TRAIN_ROWS = 6000
BUCKETS = Buckets((3, 4), 16, words=True)
DIM, EPOCHS, RATE = 8, 6, 0.5


@dataclass
class Embeddings:
    """``weight``: for each bucket its vector times the difference of the two output columns."""

    weight: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = BUCKETS.sums(data, offsets, self.weight[:, None])
        return 1 / (1 + np.exp(-np.clip(total[:, 0] / np.maximum(count, 1) + self.bias, -30, 30)))


def fit_embeddings(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> Embeddings:
    """``rows`` are buckets and shares of each document; a step is one document, the rarer class weighs more."""
    y = np.asarray(y, int)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Embeddings(np.zeros(BUCKETS.total), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (BUCKETS.total, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    # Rare buckets take larger steps; the scale makes a step move a document's average by its gradient.
    seen = np.full(BUCKETS.total, 1e-12)
    for at, share in rows:
        seen[at] += share.astype(float) ** 2
    pace = 1 / np.sqrt(seen / len(rows))
    pace /= np.mean([(share**2) @ pace[at] for at, share in rows if len(at)] or [1.0])
    pace = np.minimum(pace, np.quantile(pace[seen > 1e-12], 0.99)).astype(np.float32)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    weight = np.sqrt(weight)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(y)):
            at, share = rows[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= weight[y[i]]
            back = layer @ p
            layer -= 0.05 * rate * np.outer(hidden, p)
            bias -= 0.05 * rate * p
            vectors[at] -= rate * (pace[at] * share)[:, None] * back
    return Embeddings((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, train_rows: int = TRAIN_ROWS, target: str = "quality") -> Embeddings:
    """Learn ``target`` of the rows of ``labels`` that ``where`` admits. Counts are made on the executors."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "y": batch.column("y")} | sample_columns(BUCKETS, batch))

    sample = labelled_sample(docs, labels, target, train_rows, where)
    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {kind}, y int, {SAMPLE}").toArrow()  # bounded by train_rows
    order = sorted(range(len(got)), key=list(zip(*(got.column(c).to_pylist() for c in ("doc_id", "y")), strict=True)).__getitem__)
    model = fit_embeddings(Shares(got, order), got.column("y").to_numpy()[order] if order else np.empty(0, int))
    del got
    release()
    return model


def quality_scores(docs: DataFrame, model: Embeddings, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of ``docs`` and the probability of the positive class, for every row and whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast((model.weight.astype(np.float32), model.bias))  # fixed size, about 1 MB
    columns = tuple(columns)

    def run(batches):
        weight, bias = shipped.value
        own = Embeddings(weight, bias)
        for batch in slices(batches, limit=1 << 20):
            score = own.score(*text_buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score)], [*columns, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, f"{kinds}, score double")
