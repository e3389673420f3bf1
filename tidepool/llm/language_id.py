"""Language ID by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed character n-grams is learned for each bit.
A text's margins are held against every codeword: the one with the least loss, bits weighted by how
well their classifier separates the sample, is the answer, and a small lead over the next is flagged.

Texts that are null or have no letter are ``und`` with score 0, as are all texts if nothing was
learned. With one known language the answer is that one, score 1. A null ``doc_id`` is carried through
and never learned from; repeated rows are judged one by one, and learned from once for each (doc_id, lang),
by the smallest text. Further columns don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.ngrams import SAMPLE, Buckets, Shares, sample_columns
from tidepool.llm.runtime import prepare
from tidepool.llm.textbuf import release, slices, text_buffers

#: Documents learned from at most, chosen by a hash of doc_id, the same number for each language. Every language gives
#: one at least, so that the bound is the number of languages where there are more than that.
TRAIN_ROWS = 6000
BUCKETS = Buckets((1, 2, 3), 14, words=False)
EPOCHS, RATE, SCALE, AMBIGUOUS = 12, 0.5, 40.0, 0.2
_LETTER = regex.compile(r"\p{L}")


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of +-1: all ways to split up to five languages, else random columns with the rows kept far apart."""
    if n <= 5:
        bits = max(1, (1 << (n - 1)) - 1)
        return np.array([[1 if row == 0 or not (b + 1) >> (row - 1) & 1 else -1 for b in range(bits)] for row in range(n)], np.int8)
    rng = np.random.default_rng(seed)
    bits = 15 + 2 * int(np.ceil(np.log2(n)))

    def apart(code):
        agree = code.astype(np.float32) @ code.T.astype(np.float32)
        np.fill_diagonal(agree, -bits)
        return -agree.max()

    return max((rng.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(50)), key=apart)


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # a weight for each bit

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the nearest codeword, score, lead over the next) of each row of margins."""
        loss = np.stack([np.logaddexp(0, -margins * c) @ self.trust for c in self.code], axis=1)
        ordered = np.sort(loss, axis=1)
        lead = ordered[:, 1] - ordered[:, 0] if loss.shape[1] > 1 else np.full(len(loss), np.inf)
        share = np.exp(ordered[:, :1] - loss)
        return loss.argmin(axis=1), 1 / share.sum(axis=1), lead

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = BUCKETS.sums(data, offsets, self.weight)
        return SCALE * total / np.maximum(count, 1)[:, None] + self.bias


def fit_codes(rows: Sequence[tuple[np.ndarray, np.ndarray]], langs: list[str], seed: int = 3) -> Codes:
    languages = sorted(set(langs))
    code = codewords(len(languages)) if languages else np.zeros((0, 1), np.int8)
    bits = code.shape[1]
    weight, bias = np.zeros((BUCKETS.total, bits), np.float32), np.zeros(bits, np.float32)
    if len(languages) < 2:
        return Codes(languages, code, weight, bias, np.ones(bits))
    target = code[[languages.index(x) for x in langs]].astype(np.float32)
    rng = np.random.default_rng(seed)
    grown = np.full(BUCKETS.total, 1e-4, np.float32)
    for at, share in rows:
        grown[at] += share**2
    pace = (1 / np.sqrt(grown / len(rows)))[:, None]
    pace /= pace.max()
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, share = rows[i]
            margin = SCALE * (share @ weight[at]) + bias
            back = -target[i] / (1 + np.exp(np.clip(target[i] * margin, -30, 30)))
            rate = RATE * (1 - epoch / EPOCHS)
            weight[at] -= rate * SCALE * pace[at] * share[:, None] * back
            bias -= 0.01 * rate * back
    margins = np.stack([SCALE * (s @ weight[a]) + bias for a, s in rows])
    right = (margins * target > 0).mean(axis=0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Codes(languages, code, weight, bias, trust * bits / trust.sum())


def train(docs: DataFrame, where: Column | None = None, train_rows: int = TRAIN_ROWS) -> Codes:
    """Learn from ``lang`` of rows that ``where`` admits: evenly from all languages there are."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.where(where) if where is not None else rows
    known = rows.groupBy("lang").count().collect()  # a row a language
    if not known:
        return fit_codes([], [])
    quota = max(1, train_rows // len(known))
    # One pass: rows below a cut that some more than the quota are expected to pass, then the first ones of each language.
    cuts = spark.createDataFrame([(r.lang, min(1.0, (1.5 * quota + 100) / r["count"])) for r in known], "lang string, cut double")
    drawn = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40)).alias("drawn")
    few = rows.select("doc_id", "lang", drawn).join(F.broadcast(cuts), "lang").where("drawn < cut").distinct()
    chosen = few.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("drawn", "doc_id"))).where(F.col("nth") <= quota)

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang")} | sample_columns(BUCKETS, batch))

    picked = rows.where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "lang")), ["doc_id", "lang"])  # bounded by train_rows
    sample = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    got = sample.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {SAMPLE}").toArrow()
    keys = list(zip(*(got.column(c).to_pylist() for c in ("doc_id", "lang")), strict=True))
    order = sorted(range(len(got)), key=keys.__getitem__)
    model = fit_codes(Shares(got, order), [keys[i][1] for i in order])
    del got
    release()
    return model


def language_id(docs: DataFrame, model: Codes) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), ambiguous (a small lead) of every row and whole text."""
    spark = docs.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(model)  # fixed size: buckets times bits

    def run(batches):
        model = shipped.value
        for batch in slices(batches, limit=2 << 20):
            data, offsets = text_buffers(batch.column("text"))
            n = len(offsets) - 1
            ascii_letter = np.r_[0, np.cumsum(((data | 32) >= 97) & ((data | 32) <= 122))]
            letter = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for d in np.flatnonzero(~letter & (offsets[1:] > offsets[:-1])):
                letter[d] = _LETTER.search(bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace")) is not None
            if model.languages:
                best, score, lead = model.decode(model.margins(data, offsets))
            else:
                best, score, lead, letter = np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool)
            names = [model.languages[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array(letter & (lead < AMBIGUOUS))], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, ambiguous boolean")
