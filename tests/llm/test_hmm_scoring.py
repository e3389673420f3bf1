import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.common import DOC_SCHEMA, awkward, frame, shared
from tidepool.llm import hmm_scoring as op
from tidepool.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    return op.Model(rng.dirichlet(np.ones(op.STATES)), rng.dirichlet(np.ones(op.STATES), op.STATES), rng.dirichlet(np.ones(op.SYMBOLS + 1), op.STATES).T)


def test_forward_backward_equals_all_paths():
    model = small_model()
    sequences = [[op.END], [5, 6, op.END], [7, op.END], [1, 2, 1, op.END]]
    counts = op.Counts.empty()
    got = op.log_likelihood(model, np.array(sum(sequences, [])), np.array([len(s) for s in sequences]), counts)
    start, move, emit = np.zeros(op.STATES), np.zeros((op.STATES, op.STATES)), np.zeros((op.SYMBOLS + 1, op.STATES))
    for s, value in zip(sequences, got, strict=True):
        paths = {}
        for path in itertools.product(range(op.STATES), repeat=len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            paths[path] = p
        total = sum(paths.values())
        assert math.isclose(math.log(total), value, rel_tol=1e-9)
        for path, p in paths.items():
            start[path[0]] += p / total
            for t, (symbol, state) in enumerate(zip(s, path, strict=True)):
                emit[symbol, state] += p / total
                if t:
                    move[path[t - 1], state] += p / total
    for a, b in ((counts.start, start), (counts.move, move), (counts.emit, emit)):
        np.testing.assert_allclose(a, b, atol=1e-9)


def test_rounds_raise_likelihood():
    rng = np.random.default_rng(2)
    sequences = [np.r_[rng.integers(0, 40, 30) + 100 * (i % 3), op.END].astype(np.int32) for i in range(60)]
    sizes, flat = np.array([31] * 60), np.concatenate(sequences)
    model, last = small_model(3), -np.inf
    for _ in range(5):
        counts = op.Counts.empty()
        now = op.log_likelihood(model, flat, sizes, counts).sum()
        assert now >= last - 1e-6
        last, model = now, counts.model()


def test_query_equals_brute_force(spark, tmp_path):
    rows = awkward() + [(100 + i, *r[1:]) for i, r in enumerate(shared(51, 80))]
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in queries.op10_hmm_scoring(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    tokens = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) + [None] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c = Counter(t for r, ts, h in zip(rows, tokens, held, strict=True) if r[0] is not None and not h for t in ts)
    n, v = sum(c.values()), len(c)
    seen = Counter()
    for r, ts, h in zip(rows, tokens, held, strict=True):
        match = [g for g in got[r[0]] if g.n_tokens == len(ts) and g.held_out == h and g.n_known == sum(c[t] > 0 for t in ts) and g.train_tokens == n and math.isclose(g.base_score, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)]
        assert match, r[0]
        assert all(g.score < 0 and math.isfinite(g.score) for g in match)
        seen[r[0]] += 1
    assert {k: len(x) for k, x in got.items()} == dict(seen)


def test_distributions_and_equal_texts(spark):
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(["a b", "a c a", "d"] * 3)])
    scored = {r.doc_id: r for r in op.hmm_scores(docs, F.lit(True)).collect()}
    assert len(scored) == 9 and scored[0].score == scored[3].score


def test_nothing_to_learn(spark):
    docs = frame(spark, awkward())
    got = op.hmm_scores(docs, F.lit(False)).collect()
    assert len(got) == len(awkward()) and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in got)
    assert op.hmm_scores(frame(spark, []), F.lit(True)).count() == 0


def kinds_of_documents(n: int) -> list[tuple]:
    """Documents of four vocabularies; the last vocabulary is only in the last eighth of the rows."""
    rng = np.random.default_rng(8)
    kind = [3 if i >= n - n // 8 else i % 3 for i in range(n)]
    return [(i, " ".join(f"{'abcd'[k]}{w}" for w in rng.integers(0, 60, 25)), None, None, None) for i, k in enumerate(kind)]


def captured(monkeypatch) -> list:
    models, learn = [], op.learned
    monkeypatch.setattr(op, "learned", lambda *a: models.append(learn(*a)) or models[-1])
    return models


def test_starting_point_is_found_on_all_documents(spark, monkeypatch):
    rows = kinds_of_documents(2400)
    models = captured(monkeypatch)
    scored = {r.doc_id: r for r in op.hmm_scores(spark.createDataFrame(rows, DOC_SCHEMA), F.lit(True), rounds=0).collect()}
    model = models[0]
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and np.isclose(model.start.sum(), 1)
    for a in range(0, 2400, 300):  # each kind has a state of its own, also that of the last rows
        assert np.mean([scored[i].score - scored[i].base_score for i in range(a, a + 300)]) > 5
    again = op.hmm_scores(spark.createDataFrame(rows[::-1], DOC_SCHEMA).repartition(7), F.lit(True), rounds=0).collect()
    assert all(math.isclose(r.score, scored[r.doc_id].score, rel_tol=1e-6) for r in again)


def test_scores_equal_brute_force(spark, monkeypatch):
    """The score of each document by the plain forward recursion over P(symbol | state) (c + 1) / (C + V + 1)."""
    import pyarrow as pa

    from tidepool.llm.textbuf import Words, text_buffers

    rows = [(i, *r[1:]) for i, r in enumerate(shared(61, 50))] + [(100, None, None, None, None), (101, "never seen words", None, None, None)]
    models = captured(monkeypatch)
    train = F.col("doc_id") % 3 != 2
    got = {r.doc_id: r for r in op.hmm_scores(spark.createDataFrame(rows, DOC_SCHEMA), train).collect()}
    model = models[0]
    tokens = {r[0]: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) for r in rows}
    c = Counter(t for i, ts in tokens.items() if i % 3 != 2 for t in ts)
    symbol = {t: int(op.symbols_of(Words(*text_buffers(pa.array([t]))).hashes(lower=True))[0]) for ts in tokens.values() for t in ts}
    whole, kinds = Counter(), Counter()
    for t, k in c.items():
        whole[symbol[t]] += k
        kinds[symbol[t]] += 1
    for i, ts in tokens.items():
        alpha, logs = None, 0.0
        for t in [*ts, None]:
            s = op.END if t is None else symbol[t]
            alpha = [(model.start[k] if alpha is None else sum(alpha[j] * model.move[j, k] for j in range(op.STATES))) * model.emit[s, k] for k in range(op.STATES)]
            logs += math.log10(sum(alpha)) + (0 if t is None else math.log10((c[t] + 1) / (whole[s] + kinds[s] + 1)))
            alpha = [x / sum(alpha) for x in alpha]
        assert math.isclose(got[i].score, logs, rel_tol=1e-9), i
