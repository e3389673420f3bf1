import random
import re

import numpy as np
import pyarrow as pa

from tests.llm.common import awkward, frame, shared
from tidepool.llm import minhash_dedup as op
from tidepool.llm.components import components
from tidepool.llm.textbuf import text_buffers

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        name = min(ids) if ids and sets[i] else r[0]
        out.append((r[0], len(sets[i]), name, r[0] == name))
    return out


def near_group(seed, n):
    """Copies of one text, each with its own few changes, some chained, so that most pairs are not similar."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(10_000)}" for _ in range(100)]
    out = []
    for i in range(n):
        words = list(out[-1][1].split(" ")) if i % 7 == 3 and out else list(base)
        for k in rnd.sample(range(100), 2):
            words[k] = f"x{rnd.randrange(10**6)}"
        out.append((i, " ".join(words), None, None, None))
    return out


def check(spark, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    got = op.near_duplicates(frame(spark, rows)).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_equals_brute_force(spark):
    rows = awkward() + [(100 + i, *r[1:]) for i, r in enumerate(shared(11, 120))] + [(500 + i, *r[1:]) for i, r in enumerate(near_group(2, 60))]
    rows += [(900, "Same Words Here", None, None, None), (901, "same words here", None, None, None), (902, "other words here", None, None, None)]
    check(spark, rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 4)
    monkeypatch.setattr(op, "CHECKS", 3)
    check(spark, near_group(5, 90))


def test_large_bucket_with_few_shared_bands(spark, monkeypatch):
    """A pair at 0.75 whose only shared bands are buckets of many other texts, each of which is like no other."""
    monkeypatch.setattr(op, "BLOCK", 2)
    core = " ".join(f"c{i}" for i in range(9))
    pair = [f"{core} s49091 x49091", f"{core} s49091 y49091"]
    keys = lambda texts: op.band_keys(op.signatures(*op.shingle_sets(*text_buffers(pa.array(texts)))))
    one, two = keys(pair)
    both = np.flatnonzero(one == two)
    others = [f"{core} f{i} g{i}" for i in range(600)]
    others = [text for text, key in zip(others, keys(others), strict=True) if (key[both] == one[both]).all()]
    assert 0 < len(both) <= 3 and len(others) > 4 * op.BLOCK + 1
    check(spark, [(i, text, None, None, None) for i, text in enumerate(others + pair)])


def test_empty(spark):
    assert op.near_duplicates(frame(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 150, 3000):
        both = rng.integers(0, 1 << 63, n).astype(np.uint64)
        one, two = (np.sort(np.r_[both, rng.integers(0, 1 << 63, max(1, n // 3)).astype(np.uint64)]) for _ in range(2))
        s = op.signatures(np.r_[one, two], np.array([0, len(one), len(one) + len(two)]))
        assert (s != op.OPEN).all()
        want = n / (n + 2 * max(1, n // 3))
        assert abs((s[0] == s[1]).mean() - want) < 0.17


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(300)] + [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(150)] + [(2000, 2000)] + [(3000, i) for i in range(3001, 3100)]
    rnd.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    parent = {}
    for a, b in edges:
        parent.setdefault(a, {a}), parent.setdefault(b, {b})
        merged = parent[a] | parent[b]
        for x in merged:
            parent[x] = merged
    assert got == {x: min(g) for x, g in parent.items() if len(g) > 1}
