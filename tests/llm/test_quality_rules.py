import re
from collections import Counter

import numpy as np

from tests.llm.common import awkward, frame, shared
from tidepool.llm import quality_rules as op

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_counts_equal_brute_force(spark):
    rows = awkward() + [(1000 + i, *r[1:]) for i, r in enumerate(shared(1))] + [(5000, "a b c d e f g h i " * 7, None, None, None)]
    labels = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1001, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = op.quality_rules(docs, op.fit_rules(docs, labels)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(((r[0], *counts(r[1])) for r in rows), key=key)
    assert sorted((tuple(r[:6]) for r in got), key=key) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= op.KEEP_AT)


def test_empty_tables(spark):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op.quality_rules(docs, op.fit_rules(docs, labels)).count() == 0


def test_trees_learn_and_keep_order():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + rng.normal(0, 0.1, 3000)) < 0.5).astype(float)
    trees = op.fit_trees(x, y, (-1, 0, 0))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.9
    grid = np.tile(rng.uniform(size=(50, 1, 3)), (1, 40, 1))
    grid[:, :, 0] = np.linspace(0, 1, 40)
    scores = trees.score(grid.reshape(-1, 3)).reshape(50, 40)
    assert (np.diff(scores, axis=1) <= 1e-12).all()
