"""Quality rules: gradient-boosted trees over document statistics.

``document_statistics`` turns every text into a row of counts, ``fit_trees`` boosts histogram trees
with monotonic constraints in numpy, and ``Trees.score`` walks all documents through flattened node
arrays at once. ``quality_rules`` joins both: fixed base rules first, then the verdict of the trees.

Null and empty texts have zero counts and fail the base rules. A null ``doc_id`` is carried through.
Repeated rows are judged one by one. Without labelled rows of both classes the trees answer the
share of good labels (1 without any label), so only the base rules decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.runtime import prepare
from tidepool.llm.textbuf import IS_SPACE, Words, byte_prefix, covered, duplicated, keyed, per_doc, slices, span, text_buffers

#: Labelled documents that the trees are fitted on at most, chosen by a hash of doc_id.
TRAIN_ROWS = 20_000
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: A document stays if the trees give at least this probability of a good label.
KEEP_AT = 0.5

FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "punct_share", "pipe_share", "line_words", "bare_short_lines")
#: -1: a higher value can only lower the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "pipe_share": -1}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b".,;:!?")] = True


def text_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base counts, features) of a batch of texts."""
    words = Words(data, offsets)
    space, lead = IS_SPACE[data], (data & 0xC0) != 0x80
    n_words = words.count.astype(np.int64)
    word_chars = per_doc(lead & ~space, offsets)
    n_symbols = per_doc(_SYMBOL[data], offsets)

    newline = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], newline + 1]))  # an empty document has one empty line
    line_start = line_start[np.r_[True, np.diff(line_start) > 0]] if len(line_start) else line_start
    line_start = line_start[line_start < len(data)]
    line_end = np.r_[line_start[1:], len(data)][: len(line_start)]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    line_end = np.minimum(line_end, offsets[line_doc + 1])
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end - 1, 0)] == 10)) if len(line_end) else line_end
    line_words = np.searchsorted(words.starts, line_end) - np.searchsorted(words.starts, line_start)
    full = line_words > 0
    key = keyed(line_doc[full], span(byte_prefix(data), line_start[full], line_end[full]))
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), np.int64)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    docs = len(offsets) - 1
    n_lines = np.bincount(line_doc[full], minlength=docs)
    n_dup_lines = np.bincount(line_doc[full], weights=again, minlength=docs).astype(np.int64)

    hashes = words.hashes()
    at, window = words.windows(hashes, REPEAT_WINDOW)
    twice = at[duplicated(keyed(words.doc[at], window))]
    n_repeat_words = per_doc(covered(len(hashes), twice, twice + REPEAT_WINDOW), words.first)
    order = np.sort(keyed(words.doc, hashes))
    same = duplicated(keyed(words.doc, hashes))
    n_once = n_words - per_doc(same, words.first)

    base = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}
    chars, w, lines = np.maximum(per_doc(lead, offsets), 1), np.maximum(n_words, 1), np.maximum(n_lines, 1)
    short = np.bincount(line_doc[full], weights=line_words[full] <= 3, minlength=docs)
    features = np.stack([
        np.log1p(n_words), word_chars / w, n_symbols / chars, n_dup_lines / lines, n_repeat_words / w, n_once / w,
        per_doc(_DIGIT[data], offsets) / chars, per_doc(_UPPER[data], offsets) / chars, per_doc(_PUNCT[data], offsets) / w,
        per_doc(data == 124, offsets) / w, n_words / lines, short / lines,
    ], axis=1)
    return base, features


@dataclass
class Trees:
    """All trees in flat node arrays; a leaf points at itself."""

    prior: float
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    roots: list[int] = field(default_factory=list)
    depth: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boost logistic-loss trees on binned features.

    A split on a constrained feature is taken only if its child values are in order, and both
    subtrees are then held on their side of the children's midpoint.
    """
    if not len(y) or y.min() == y.max():
        mean = float(np.clip(y.mean() if len(y) else 1.0, 1e-6, 1 - 1e-6))
        return Trees(float(np.log(mean / (1 - mean))))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    mean = y.mean()
    prior = float(np.log(mean / (1 - mean)))
    margin = np.full(len(y), prior)
    nodes: list[list[float]] = []
    roots = []

    def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
        me = len(nodes)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(-total_g / (total_h + l2), low, high))
        nodes.append([0, np.inf, me, me, value * rate])
        if level == depth:
            margin[rows] += value * rate
            return me
        best = (1e-6, None)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            gl = np.cumsum(np.bincount(binned[rows, f], weights=g[rows], minlength=len(e) + 1))[:-1]
            hl = np.cumsum(np.bincount(binned[rows, f], weights=h[rows], minlength=len(e) + 1))[:-1]
            gr, hr = total_g - gl, total_h - hl
            vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total_g**2 / (total_h + l2)
            gain[(hl < least * 0.05) | (hr < least * 0.05) | (monotone[f] * (vr - vl) < 0)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (f, k, vl[k], vr[k]))
        if best[1] is None:
            margin[rows] += value * rate
            return me
        f, k, vl, vr = best[1]
        mid = (vl + vr) / 2
        lows, highs = [low, low], [high, high]
        if monotone[f] > 0:
            highs[0], lows[1] = mid, mid
        elif monotone[f] < 0:
            lows[0], highs[1] = mid, mid
        goes = binned[rows, f] <= k
        nodes[me][:2] = [f, edges[f][k]]
        nodes[me][2] = grow(rows[goes], level + 1, lows[0], highs[0], g, h)
        nodes[me][3] = grow(rows[~goes], level + 1, lows[1], highs[1], g, h)
        return me

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), 0, -4.0, 4.0, p - y, np.maximum(p * (1 - p), 1e-6)))
    flat = np.array(nodes)
    return Trees(prior, flat[:, 0].astype(np.int32), flat[:, 1], flat[:, 2].astype(np.int32), flat[:, 3].astype(np.int32), flat[:, 4], roots, depth)


def _map(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """One row of counts a document; with trees also their score."""
    prepare(docs.sparkSession)
    extra = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches):
        for batch in slices(batches):
            base, features = text_counts(*text_buffers(batch.column("text")))
            columns = {"doc_id": batch.column("doc_id")} | {c: batch.column(c) for c in extra} | {k: pa.array(v) for k, v in base.items()}
            if trees is None:
                columns |= {f: pa.array(features[:, i]) for i, f in enumerate(FEATURES)}
            else:
                columns["score"] = pa.array(trees.score(features))
            yield pa.RecordBatch.from_pydict(columns)

    kinds = "".join(f", {f} double" for f in FEATURES) if trees is None else ", score double"
    own = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}{own}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long{kinds}")


def document_statistics(docs: DataFrame) -> DataFrame:
    """Counts and features of every text of ``docs`` (doc_id, text)."""
    return _map(docs.select("doc_id", "text"), None)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, where=None) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, those with the smallest hash of doc_id; of rows with one doc_id the smallest text."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # Both sides of the broadcast are bounded by `rows`, however often a doc_id is repeated.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit_rules(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, target: str = "quality") -> Trees:
    sample = _map(labelled_sample(docs, labels, target, train_rows), None).toPandas().sort_values(["doc_id", "log_words"])
    return fit_trees(sample[list(FEATURES)].to_numpy(float), sample["y"].to_numpy(float), tuple(MONOTONE.get(f, 0) for f in FEATURES))


def quality_rules(docs: DataFrame, trees: Trees, keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, the five counts, base_failed, the trees' score, kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    out = _map(docs.select("doc_id", "text"), trees).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= keep_at))
