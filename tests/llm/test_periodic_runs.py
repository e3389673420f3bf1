import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tests.llm.common import awkward, frame
from tidepool.llm import periodic_runs as op
from tidepool.llm import queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(t, most=None):
    """(start, end, period) of all maximal runs of two periods and more, with their smallest period."""
    n, out = len(t), set()
    for q in range(1, min(n // 2, most or n) + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            if j - i >= q and not any(all(t[x] == t[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.add((i, j + q, q))
            i = max(j, i + 1) + (j > i)
    return out


def found(t):
    return set(zip(*[x.tolist() for x in op.runs_of(np.array(t, np.int64))], strict=True))


def text_of(rnd):
    n, letters = rnd.randint(0, 70), rnd.choice([1, 2, 2, 3, 4])
    t = [rnd.randrange(letters) for _ in range(n)]
    return (t[: rnd.randint(1, 9)] * 20)[:n] + t[: rnd.randint(0, 5)] if rnd.random() < 0.3 else t


def test_all_runs(spark):
    rnd = random.Random(7)
    for _ in range(1500):
        t = text_of(rnd)
        assert found(t) == brute(t), t


def test_vocabulary_holds_every_primitive_square_once():
    rnd = random.Random(9)
    for _ in range(300):
        t = text_of(rnd)
        if not t:
            continue
        s = op.Suffixes(np.array(t, np.int64))
        low, high, k = op.vocabulary(s)
        got = [tuple(t[i : i + 2 * n]) for i, n in zip(s.order[low].tolist(), k.tolist(), strict=True)]
        squares = {tuple(t[i : i + 2 * n]) for n in range(1, len(t) // 2 + 1) for i in range(len(t) - 2 * n + 1) if t[i : i + n] == t[i + n : i + 2 * n]}
        want = {x for x in squares if not any(x == x[:r] * (len(x) // r) for r in range(1, len(x) // 2) if (len(x) // 2) % r == 0)}
        assert len(got) == len(set(got)) and set(got) == want, t
        counts = {x: sum(tuple(t[i : i + len(x)]) == x for i in range(len(t))) for x in want}
        assert [counts[x] for x in got] == (high - low).tolist()


def test_fibonacci_word_and_long_runs():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert found(b) == brute(b)
    assert found([5] * 40_000) == {(0, 40_000, 1)}
    assert found(list(range(700)) * 40) == {(0, 28_000, 700)}


def want_row(text, exponent, least):
    words = WORD.findall(text or "")
    runs = sorted((a, b - a, q) for a, b, q in brute(words) if b - a >= max(least, exponent * q))
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize(("exponent", "least"), [(4, 6), (2, 2), (3, 20)])
def test_operator_equals_brute_force(spark, exponent, least):
    rnd = random.Random(exponent)
    texts = [" ".join(rnd.choice(["a", "b", "é", "A"]) for _ in range(rnd.randint(0, 50))) for _ in range(60)]
    texts += ["x\ty z  " * rnd.randint(1, 9) + "x y" for _ in range(10)] + ["go\n" * 7, "go " * 5, "a b " * 4, "a b " * 3 + "a"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(900, None, None, None, None), (None, "go " * 30, None, None, None), (3, "go " * 30, None, None, None)]
    got = op.collapse_runs(frame(spark, rows), exponent, least).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]))
    want = [(r[0], *want_row(r[1], exponent, least)) for r in rows]
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)


def test_awkward_and_very_long(spark):
    rows = [*awkward(), (700, "word " * 400_000, None, None, None), (701, " ".join(str(i) for i in range(300_000)), None, None, None), (702, " ".join(["p q", *map(str, range(90_000))] * 5), None, None, None)]
    got = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], len(r.collapsed)) for r in op.collapse_runs(frame(spark, rows)).collect()}
    assert got[700, 400_000] == ([(0, 400_000, 1)], 4)
    assert got[701, 300_000][0] == [] and got[702, 450_010][0] == [(0, 450_010, 90_002)]
    assert op.collapse_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        op.collapse_runs(frame(spark, []), 1)


def contract(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = sorted((a, b - a, q) for a, b, q in brute([codes[w] for w in words], n // 4) if b - a >= max(6, 4 * q))
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{a},{m},{q}\n" for a, m, q in runs)), digest(left))


def test_query_equals_brute_force(spark):
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in table if r["text"] is None or len(r["text"]) < 30_000] + [(10_000 + i, "so " * i) for i in range(40)] + [(20_000, None), (20_001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, queries.run_digests(op.collapse_runs(queries.with_periods(docs))).collect()))
    want = sorted(contract(*r) for r in rows)
    assert sum(w[1] > 0 for w in want) > 10
    assert got == want
