import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.common import awkward, frame, shared
from tidepool.llm import queries
from tidepool.llm import source_divergence as op

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=3, top=200):
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        terms = TERM.findall((text or "").translate(FOLD))
        counts[lang or "", source or ""].update(terms)
        seen[lang or ""].update(set(terms))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= least]
        own = {s: c for (x, s), c in counts.items() if x == lang}
        own = {s: {t: c[t] for t in kept} for s, c in own.items()}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in own.items()}, share({t: sum(c[t] for c in own.values()) for t in kept})
        gap = lambda a, b: (a - b) ** 2 // b
        for s in own:
            parts = [("pair", o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            parts = [parts, [("term", t, gap(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]]
            for i, part in enumerate(parts):
                part.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, n + 1) for n, r in enumerate(part[: top if i else None])]
    return sorted(out)


def some(seed):
    rnd = random.Random(seed)
    rows = [(r[0], r[1], r[2], rnd.choice(["a", "b", "ç", None, ""]), None) for r in shared(seed, 80)]
    rows += [(1000 + i, " ".join(rnd.choice(["Été", "ÉTÉ", "aB", "ab1ba", "中文", "x" * 300, "under_score", "a-b", "\x7f", "a b"]) for _ in range(9)), rnd.choice(["fr", None]), rnd.choice(["a", "z"]), None) for i in range(20)]
    return [*rows, *awkward(), rows[3], rows[3], (5000, "only one", "xx", "lonely", None), (5001, None, "yy", None, None), (5002, "two three", "yy", "b", None)]


@pytest.mark.parametrize("p", [op.Settings(), op.Settings(3, 4, 1, 500, 3, 20)])
def test_equals_brute_force(spark, p):
    rows = some(p.prefix)
    got = sorted(map(tuple, op.source_divergence(frame(spark, rows), p).collect()))
    want = brute(rows, top=p.top)
    assert got == want and {r[2] for r in want} == {"pair", "term"}
    assert any(r[3] == "b" and r[4] == 0 for r in want if r[0] == "yy")  # no kept terms: 0 for every pair


def test_tries_merge_and_walk_in_byte_order():
    rnd = random.Random(3)
    terms = ["".join(rnd.choice("abé中z") for _ in range(rnd.randint(0, 6))).encode() for _ in range(800)]
    leaves = [(t, 1, [("s", 2), (str(i % 3), 1)]) for i, t in enumerate(terms)]

    def grown(leaves):
        names = pa.array(["0", "1", "2", "s"])
        flat = [(names.to_pylist().index(s), n) for _, _, c in leaves for s, n in c]
        return op.Trie.merged(pa.array([t for t, _, _ in leaves]), np.array([d for _, d, _ in leaves]), np.array([len(c) for _, _, c in leaves]), names, np.array([s for s, _ in flat]), np.array([n for _, n in flat]))

    for depth in (1, 3, 50):
        rows = [grown(part).rows("x", depth) for part in (leaves[:300], leaves[300:], leaves[:0]) if part]
        trie = op._grown(pa.Table.from_batches(rows))
        got = trie.terms.to_pylist()
        assert got == sorted(set(terms))
        assert dict(zip(got, trie.documents.tolist(), strict=True)) == Counter(terms)
        assert trie.count[trie.source == trie.names.to_pylist().index("s")].tolist() == (2 * trie.documents).tolist()
        heads = [got[i][:depth] for i in trie.subtries(depth)[:-1]]
        assert heads == sorted({t[:depth] for t in terms})


def test_shares_are_exact():
    rnd = random.Random(1)
    for _ in range(300):
        total = rnd.randint(1, 9 * 10**15)
        n = rnd.randint(1, total)
        assert op.shares(np.array([n]), np.array([total])).tolist() == [1 + 10**9 * n // total]


def test_empty(spark):
    assert op.source_divergence(frame(spark, [])).count() == 0


def test_query_equals_sql(spark):
    from tests.oracle import rows

    got, want = rows(spark, "op13", queries.op13_source_divergence, queries.ORACLES["op13_source_divergence"], "/root/testdata/sf0.001")
    assert got == want and got
