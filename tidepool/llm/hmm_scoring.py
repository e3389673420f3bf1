"""LM scoring by a hidden Markov model over words.

Texts become blocks: one row holds many documents as token numbers into the block's own list of word
hashes, frequent ones first. Corpus counts of every word are aggregated over all blocks and joined back
to each block's list, so neither the vocabulary nor its counts are ever gathered in one place. From then
on a block holds its tokens' symbols and what the counts say of each document.

A word belongs to one of 2**SYMBOL_BITS symbols by its hash, the end of a text is a symbol of its own.
The model emits symbols from latent states and, given the symbol, a word by its smoothed share of the
symbol's tokens: P(word | state) = P(symbol | state) (c + 1) / (C + V + 1), where C and V are the
tokens and different words of the symbol in training; 1 / (C + V + 1) is left for an unseen word.
Baum-Welch counts are summed over all training documents in every round: each task adds up those of its
documents, and the sums meet in slices. So does all that the starting point is made from. A text's
score is its exact log10 probability by the scaled forward recursion over all its tokens.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; null and empty texts have the end only. A row with a
null doc_id is scored and not learned from. Without training rows all counts are 0 and the states uniform.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.runtime import discard, prepare, stored
from tidepool.llm.textbuf import U64, Words, slices, text_buffers

SYMBOL_BITS = 14
SYMBOLS = 1 << SYMBOL_BITS
END = SYMBOLS
STATES, ROUNDS = 4, 2
#: Of the starting point: symbols that part the kinds of documents, and rounds that take in all other symbols.
FREQUENT, MIXTURE_ROUNDS = 256, 3
BLOCK_BYTES = 12 << 20
GROUP_TOKENS = 600_000
SLICES = 16


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # (symbols + end) x states


@dataclass
class Counts:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def empty() -> Counts:
        return Counts(np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((SYMBOLS + 1, STATES)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.start, self.move.ravel(), self.emit.ravel()])

    @staticmethod
    def of(flat: np.ndarray) -> Counts:
        return Counts(flat[:STATES], flat[STATES : STATES + STATES**2].reshape(STATES, STATES), flat[STATES + STATES**2 :].reshape(-1, STATES))

    def model(self) -> Model:
        """Each distribution from its counts and one more observation spread as the whole corpus is (evenly, without one)."""
        share = self.emit.sum(axis=1) + 1 / (SYMBOLS + 1)
        emit = self.emit + (share / share.sum())[:, None]
        move, start = self.move + 1 / STATES, self.start + 1 / STATES
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def symbols_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - SYMBOL_BITS)).astype(np.int32)


def _groups(sizes: np.ndarray):
    """Documents in groups of similar length, longest first."""
    order = np.argsort(-sizes, kind="stable")
    total = np.cumsum(sizes[order])
    for a, b in zip(*(lambda cut: (np.r_[0, cut], np.r_[cut, len(order)]))(np.flatnonzero(np.diff(total // GROUP_TOKENS)) + 1), strict=True):
        if a < b:
            yield order[a:b]


def _laid_out(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """(symbols by step, how many documents reach each step, where each step's stretch begins), documents longest first."""
    longest = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    begin = np.r_[0, np.cumsum(alive)]
    rank = np.arange(int(begin[-1])) - np.repeat(begin[:-1], alive)
    step = np.repeat(np.arange(longest), alive)
    return symbols[starts[rank] + step], alive.tolist(), begin.tolist()


def log_likelihood(model: Model, symbols: np.ndarray, sizes: np.ndarray, counts: Counts | None = None) -> np.ndarray:
    """Natural log probability of each sequence; ``symbols`` holds all of them in turn, each with its end.

    With ``counts`` the expected starts, moves and emissions are added to it (forward-backward).
    """
    out = np.zeros(len(sizes))
    bounds = np.r_[0, np.cumsum(sizes)][:-1]
    for docs in _groups(sizes):
        seq, alive, begin = _laid_out(symbols, bounds[docs], sizes[docs])
        emit = model.emit[seq]
        alpha = np.empty_like(emit)
        scale = np.empty(len(seq))
        now = model.start * emit[: alive[0]]
        for t in range(len(alive)):
            a, b = begin[t], begin[t + 1]
            if t:
                now = (now[: b - a] @ model.move) * emit[a:b]
            s = now.sum(axis=1)
            scale[a:b] = s
            now /= s[:, None]
            alpha[a:b] = now
        rank = np.arange(len(seq)) - np.repeat(begin[:-1], alive)
        out[docs] = np.bincount(rank, weights=np.log(scale), minlength=len(docs))
        if counts is None:
            continue
        gamma = alpha  # becomes the state shares from the last step back
        back = np.ones((0, STATES))
        ratio = emit / scale[:, None]
        for t in range(len(alive) - 1, 0, -1):
            a, b = begin[t], begin[t + 1]
            beta = np.ones((b - a, STATES))
            beta[: len(back)] = back
            gain = ratio[a:b] * beta
            counts.move += model.move * (alpha[begin[t - 1] : begin[t - 1] + b - a].T @ gain)
            gamma[a:b] *= beta
            back = gain @ model.move.T
        gamma[: len(back)] *= back
        counts.start += gamma[: alive[0]].sum(axis=0)
        for s in range(STATES):
            counts.emit[:, s] += np.bincount(seq, weights=gamma[:, s], minlength=SYMBOLS + 1)
    return out


def clusters_of(together: np.ndarray) -> np.ndarray:
    """A state for each of some symbols, by how often two of them stand in one document: spectral, with centres far apart."""
    often = np.sqrt(np.maximum(np.diag(together), 1e-12))
    near = together / often[:, None] / often
    near /= np.sqrt(np.outer(near.sum(axis=1), near.sum(axis=1)))
    _, vectors = np.linalg.eigh(near)
    place = vectors[:, -STATES:]
    place = place / np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-12)
    chosen = [0]
    while len(chosen) < min(STATES, len(place)):
        chosen.append(int(np.abs(place @ place[chosen].T).max(axis=1).argmin()))
    centres = place[chosen]
    for _ in range(10):
        own = (place @ centres.T).argmax(axis=1)
        centres = np.stack([place[own == s].mean(axis=0) if (own == s).any() else centres[s] for s in range(len(centres))])
    return own


def _together(place: np.ndarray, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """In how many documents each two of the symbols that have a ``place`` stand."""
    n, at, doc = int(place.max()) + 1, place[symbols], np.repeat(np.arange(len(sizes)), sizes)
    out, doc, at = np.zeros((n, n)), doc[at >= 0], at[at >= 0]
    for a in range(0, len(sizes), 4096):
        lo, hi = np.searchsorted(doc, [a, a + 4096])
        holds = np.zeros((min(4096, len(sizes) - a), n), np.float32)
        holds[doc[lo:hi] - a, at[lo:hi]] = 1
        out += holds.T @ holds
    return out.ravel()


def _mixture(kinds: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Documents of each kind, and their symbols, by each document's shares of the kinds."""
    doc, logs = np.repeat(np.arange(len(sizes)), sizes), np.log(kinds.emit)
    fit = np.stack([np.bincount(doc, weights=logs[symbols, s], minlength=len(sizes)) for s in range(STATES)], axis=1) + np.log(kinds.start)
    share = np.exp(fit - fit.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return np.r_[share.sum(axis=0), np.stack([np.bincount(symbols, weights=share[doc, s], minlength=SYMBOLS + 1) for s in range(STATES)], axis=1).ravel()]


def _expected(model: Model, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    counts = Counts.empty()
    log_likelihood(model, symbols, sizes, counts)
    return counts.flat()


def starting_point(blocks: DataFrame, symbol_tokens: np.ndarray) -> Model:
    """A model whose states are kinds of documents, found on all training documents.

    The most frequent symbols are parted by the documents that they share; that tells kinds of documents apart, and
    a few rounds of a mixture over documents bring in all other symbols.
    """
    top = np.argsort(-symbol_tokens, kind="stable")[:FREQUENT]
    top = top[symbol_tokens[top] > 0]
    if len(top) < STATES:
        return Counts.empty().model()
    place = np.full(SYMBOLS + 1, -1)
    place[top] = np.arange(len(top))

    own = clusters_of(_summed(blocks, _together, place, len(top) ** 2).reshape(len(top), len(top)))
    emit = np.repeat((symbol_tokens + 1.0)[:, None], STATES, axis=1)
    emit[top] *= np.where(own[:, None] == np.arange(STATES), 1.0, 0.1)
    emit, weight = np.r_[emit, np.full((1, STATES), emit.sum() / STATES / 100)], np.full(STATES, 1 / STATES)
    for _ in range(MIXTURE_ROUNDS):
        given = Model(weight, np.empty(0), emit / emit.sum(axis=0))
        sums = _summed(blocks, _mixture, given, STATES * (SYMBOLS + 2))
        weight, emit = (sums[:STATES] + 1) / (sums[:STATES] + 1).sum(), sums[STATES:].reshape(-1, STATES)
        emit = emit + 0.05 * (emit.sum(axis=1, keepdims=True) / STATES + 0.01)
    return Model(weight, np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1)), emit / emit.sum(axis=0))


def _blocks(docs: DataFrame, train: Column) -> DataFrame:
    """Rows (block, doc_ids, train, sizes, words, low, high): all documents of about BLOCK_BYTES of text, tokenised.

    ``low`` and ``high`` are the lower two bytes and the rest of the token numbers.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def packed(parts):
        ids, flags, sizes, hashes = ([p[i] for p in parts] for i in range(4))
        words, tokens, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-times, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        tokens = place[tokens]
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([uuid.uuid4().int >> 65]), "doc_ids": pa.array([sum((x.to_pylist() for x in ids), [])], pa.list_(ids[0].type)), "train": pa.array([np.concatenate(flags).tobytes()], pa.binary()),
                "sizes": pa.array([np.concatenate(sizes).astype(np.int32).tobytes()], pa.binary()), "words": pa.array([words[order].tobytes()], pa.binary()),
                "low": pa.array([tokens.astype(np.uint16).tobytes()], pa.binary()), "high": pa.array([(tokens >> 16).astype(np.uint8 if len(words) < 1 << 24 else np.int32).tobytes()], pa.binary()),
            }
        )

    def run(batches):
        parts, size = [], 0
        for batch in slices(batches, limit=2 << 20):
            data, offsets = text_buffers(batch.column("text"))
            words = Words(data, offsets)
            parts.append((batch.column("doc_id"), pc.fill_null(batch.column("train"), False).to_numpy(zero_copy_only=False).astype(np.uint8), words.count, words.hashes(lower=True)))
            size += len(data)
            if size >= BLOCK_BYTES:
                yield packed(parts)
                parts, size = [], 0
        if parts:
            yield packed(parts)

    return docs.select("doc_id", "text", train.alias("train")).mapInArrow(run, f"block long, doc_ids array<{kind}>, train binary, sizes binary, words binary, low binary, high binary")


def _array(column: pa.Array, i: int, dtype) -> np.ndarray:
    return np.frombuffer(column[i].as_py(), dtype)


def _tokens(batch, i: int, words: int) -> np.ndarray:
    high = _array(batch.column("high"), i, np.uint8 if words < 1 << 24 else np.int32)
    return _array(batch.column("low"), i, np.uint16).astype(np.int32) | high.astype(np.int32) << 16


def _word_rows(blocks: DataFrame) -> DataFrame:
    """(block, place, word, n): every word of every block's list with its tokens in training documents."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                words = _array(batch.column("words"), i, np.int64)
                train = np.repeat(_array(batch.column("train"), i, np.uint8), _array(batch.column("sizes"), i, np.int32))
                n = np.bincount(_tokens(batch, i, len(words)), weights=train, minlength=len(words)).astype(np.int64)
                for a in range(0, len(words), 50_000):
                    part = words[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column("block")[i].as_py())), pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part), pa.array(n[a : a + 50_000])], ["block", "place", "word", "n"])

    return blocks.select("block", "train", "sizes", "words", "low", "high").mapInArrow(run, "block long, place int, word long, n long")


def _lists(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, places, c): the places in a block's list of words that training has, and their corpus counts."""
    found = rows.select("block", "place", "word").join(counts, "word").select("block", "place", "c")

    def run(batches):
        now, places, c = None, [], []

        def packed():
            return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int64()), "places": pa.array([np.concatenate(places).tobytes()], pa.binary()), "c": pa.array([np.concatenate(c).tobytes()], pa.binary())})

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now and places:
                    yield packed()
                    places, c = [], []
                now = int(block[a])
                places.append(batch.column("place").to_numpy()[a:b])
                c.append(batch.column("c").to_numpy()[a:b])
        if places:
            yield packed()

    return found.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block long, places binary, c binary")


def _counted(blocks: DataFrame, lists: DataFrame, symbol_totals, n: int, v: int) -> DataFrame:
    """Rows (doc_ids, train, sizes, symbols, known, base, given): token symbols, and sums over each document's words.

    ``known`` counts words seen in training, ``base`` adds their unigram log10 probabilities, ``given`` those given their symbols.
    """
    kind = blocks.schema["doc_ids"].dataType.simpleString()

    def run(batches):
        whole = symbol_totals.value
        for batch in batches:
            for i in range(batch.num_rows):
                words, sizes = _array(batch.column("words"), i, np.uint64), _array(batch.column("sizes"), i, np.int32)
                c = np.zeros(len(words), np.int64)
                if batch.column("places")[i].is_valid:
                    c[_array(batch.column("places"), i, np.int32)] = _array(batch.column("c"), i, np.int64)
                tokens, symbols = _tokens(batch, i, len(words)), symbols_of(words)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                total = lambda x: np.bincount(doc, weights=x[tokens], minlength=len(sizes))
                sums = (total(c > 0).astype(np.int64), total(np.log10((c + 1) / (n + (v + 1)))), total(np.log10((c + 1) / whole[symbols])))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(x).slice(i, 1) for x in ("doc_ids", "train", "sizes")), pa.array([symbols[tokens].astype(np.uint16).tobytes()], pa.binary()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)],
                    ["doc_ids", "train", "sizes", "symbols", "known", "base", "given"],
                )

    joined = blocks.join(lists, "block", "left").select("doc_ids", "train", "sizes", "words", "low", "high", "places", "c")
    return joined.mapInArrow(run, f"doc_ids {kind}, train binary, sizes binary, symbols binary, known binary, base binary, given binary")


def _sequences(batch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all documents of a block in turn, each with its end; their sizes)."""
    sizes = _array(batch.column("sizes"), i, np.int32).astype(np.int64)
    return np.insert(_array(batch.column("symbols"), i, np.uint16).astype(np.int32), np.cumsum(sizes), END), sizes + 1


def _summed(blocks: DataFrame, task: Callable, given: Model | np.ndarray, size: int) -> np.ndarray:
    """The sum of the ``size`` numbers of ``task(given, symbols, document sizes)`` over the training documents of all blocks: in each task first, then slice by slice."""
    shipped = blocks.sparkSession.sparkContext.broadcast(given)  # fixed size: symbols times states at most

    def expect(batches):
        given, sums = shipped.value, np.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, sizes = _sequences(batch, i)
                train = _array(batch.column("train"), i, np.uint8) > 0
                if train.any():
                    sums += task(given, symbols[np.repeat(train, sizes)], sizes[train])
        parts = np.array_split(sums, SLICES)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "sums"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, raw in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums[s] = sums[s] + np.frombuffer(raw) if s in sums else np.frombuffer(raw)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "sums"])

    kind = "slice int, sums binary"
    rows = blocks.select("train", "sizes", "symbols").mapInArrow(expect, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect()  # SLICES rows
    shipped.unpersist()
    return np.concatenate([np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.slice)]) if rows else np.zeros(size)


def _round(blocks: DataFrame, model: Model) -> Counts:
    """Baum-Welch counts of all training documents."""
    return Counts.of(_summed(blocks, _expected, model, len(Counts.empty().flat())))


def learned(blocks: DataFrame, symbol_tokens: np.ndarray, rounds: int) -> Model:
    """The model of all training documents in ``blocks``."""
    model = starting_point(blocks, symbol_tokens)
    for _ in range(rounds):
        model = _round(blocks, model).model()
    return model


def hmm_scores(docs: DataFrame, train: Column, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    ``train`` admits the rows to learn from. ``base_score`` is the add-one unigram log10 probability.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    admitted = F.coalesce(train, F.lit(False))
    plain = stored(_blocks(docs, admitted))
    rows = _word_rows(plain)
    counts = stored(rows.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"))
    symbol = F.shiftrightunsigned("word", 64 - SYMBOL_BITS).alias("symbol")
    per_symbol = counts.groupBy(symbol).agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # at most one row a symbol
    ends = docs.where(admitted).count()
    symbol_tokens, symbol_words = np.zeros(SYMBOLS, np.int64), np.zeros(SYMBOLS, np.int64)
    for r in per_symbol:
        symbol_tokens[r.symbol], symbol_words[r.symbol] = r.c, r.v
    n, v = int(symbol_tokens.sum()) + ends, int(symbol_words.sum()) + (ends > 0)
    lists = stored(_lists(rows, counts))
    blocks = stored(_counted(plain, lists, spark.sparkContext.broadcast(symbol_tokens + symbol_words + 1), n, v))  # one number a symbol
    discard(plain, counts, lists)

    model = learned(blocks, symbol_tokens, rounds if ends else 0)
    shipped = spark.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        model = shipped.value
        for batch in batches:
            for i in range(batch.num_rows):
                symbols, sizes = _sequences(batch, i)
                known, base, given = _array(batch.column("known"), i, np.int64), _array(batch.column("base"), i, float), _array(batch.column("given"), i, float)
                score = log_likelihood(model, symbols, sizes) / np.log(10) + given
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_ids").slice(i, 1).flatten(), pa.array(sizes), pa.array(known + (ends > 0)), pa.array(np.full(len(sizes), n)), pa.array(base + np.log10((ends + 1) / (n + (v + 1)))), pa.array(score)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return blocks.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
