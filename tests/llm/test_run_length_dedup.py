import hashlib
import random

import numpy as np
import pytest

from tests.llm.common import awkward, frame, shared
from tidepool.llm import queries
from tidepool.llm import run_length_dedup as op


def covered(raw, size):
    """Which bytes of each text strings of ``size`` bytes cover that start elsewhere too."""
    seen = {}
    for t in raw:
        for i in range(len(t) - size + 1):
            w = t[i : i + size]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        out.append(gone)
    return out


def brute(rows, length, least=240):
    raw = [(r[1] or "").encode() for r in rows]
    out = []
    for r, t, gone, shared in zip(rows, raw, covered(raw, length), covered(raw, min(least, length)), strict=True):
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((r[0], len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest(), int(shared.sum())))
    return out


def same(spark, rows, settings=op.Settings()):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in queries.removal_digests(op.remove_repeats(frame(spark, rows), settings)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, settings.length, settings.least), key=key)


def longest_matches(raw):
    best = [np.zeros(len(x), int) for x in raw]
    for i, x in enumerate(raw):
        for j, y in enumerate(raw):
            for p in range(len(x)):
                for q in range(len(y)):
                    m = 0
                    while (i, p) != (j, q) and p + m < len(x) and q + m < len(y) and x[p + m] == y[q + m]:
                        m += 1
                    best[i][p] = max(best[i][p], m)
    return best


def test_index_equals_brute_force():
    rnd = random.Random(0)
    for trial in range(60):
        alphabet = "ab" if trial % 2 else "abcdefghi"
        segments = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 8))]
        segments += [segments[0] + "x", "y" + segments[-1], "a" * 30, segments[0]]
        raw = [s.encode() for s in segments]
        index = op.build_index(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
        windows = np.array([rnd.randint(1, len(x)) for x in raw])
        want = [b[:w] for b, w in zip(longest_matches(raw), windows, strict=True)]
        np.testing.assert_array_equal(index.matching_statistics(windows), np.concatenate(want), str(segments))
        assert len(index.run_starts) <= index.n


def test_production_length(spark):
    rows = [(100 + i, *r[1:]) for i, r in enumerate(shared(21, 90))] + [r for r in awkward() if r[1] is None or len(r[1]) < 20_000]
    rows += [(900, "z" * 450, None, None, None), (901, "q" * 399, None, None, None), (902, "q" * 399, None, None, None), (903, "ab" * 200 + "c", None, None, None), (904, "ab" * 200 + "d", None, None, None)]
    rows += [(905, "And " * 150 + "end", None, None, None), (906, "x " + "And " * 130, None, None, None), (907, "one two three " * 60, None, None, None), (908, "ab" * 130, None, None, None)]
    assert any(r[2] for r in brute(rows, 400))
    same(spark, rows)


@pytest.mark.parametrize(("crowd", "least", "gram"), [(4000, 40, 16), (4000, 24, 10), (3, 24, 10), (1, 30, 16)])
def test_crowded_anchors(spark, crowd, least, gram):
    rows = [*shared(31, 80), (900, "And " * 60, None, None, None), (901, "so And And " * 20, None, None, None)]
    same(spark, rows, op.Settings(40, least, gram, 3000, crowd, 6))


def test_empty(spark):
    assert op.remove_repeats(frame(spark, [])).count() == 0


def shard_rows(raw, key=5):
    """Segments whose texts begin ``lead`` bytes before one anchor, as a shard gets them."""
    return [(key, i, i, 1, windows, lead, t) for i, (t, lead, windows) in enumerate(raw)]


def test_index_holds_only_where_repeats_can_begin(monkeypatch):
    """Segments that share an anchor but no window aren't indexed, others are cut; before, all bytes of a shard were."""
    rnd = random.Random(3)
    noise = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    anchor, passage = noise(96), noise(500)
    lone = [(noise(120) + anchor + noise(400), 120, 120) for _ in range(50)]
    # ``passage`` stands at equal places to the anchor in two segments, in a third only 399 bytes of it do.
    twins = [(noise(59) + side + passage[:n] + side + noise(539 - n), 160, 161) for side, n in ((b"A", 500), (b"B", 500), (b"C", 399))]
    held, whole = [], op.build_index
    monkeypatch.setattr(op, "build_index", lambda data, offsets, *least: held.append(len(data)) or whole(data, offsets, *least))
    rows = shard_rows(lone + twins)
    got = op._shard(rows, op.Settings()).to_pydict()
    assert sum(held) <= 3 * 560 < sum(len(r[6]) for r in rows) // 10
    assert (got["d1"], got["starts"], got["ends"]) == ([50, 51, 52], [[60], [60], []], [[560], [560], []])
    assert (got["shared_starts"], got["shared_ends"]) == ([[60], [60], [60]], [[400], [400], [400]])


@pytest.mark.parametrize("least", [1, 7, 8, 20, 28, 60])
def test_long_matches_are_sampled_whole(least):
    """With a least length, matches of that length and more are those of the whole index; shorter ones may be less."""
    rnd = random.Random(least)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(5, 50))) for _ in range(6)]
    raw = ["".join(rnd.choice(words) for _ in range(rnd.randint(1, 6))).encode() for _ in range(30)]
    data, offsets, windows = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])], np.array([len(x) for x in raw])
    want, got = (op.build_index(data, offsets, n).matching_statistics(windows) for n in (0, least))
    np.testing.assert_array_equal(got[want >= least], want[want >= least])
    assert (got <= want)[want < least].all()


def test_index_is_built_in_parts(monkeypatch):
    """One index holds a quarter of a shard's bytes, or one anchor; before, it held the whole shard with the crowded anchor at its end."""
    assert list(op._parts(np.array([1, 1, 2, 3, 3, 3, 4]), np.array([5, 5, 5, 50, 50, 50, 5]), 16)) == [(0, 3), (3, 6), (6, 7)]
    assert list(op._parts(np.array([], np.int64), np.array([], np.int64), 16)) == []
    rnd = random.Random(5)
    noise = lambda n: bytes(rnd.randrange(97, 123) for _ in range(n))
    rows = []
    for key in range(40):
        passage = noise(600)
        rows += shard_rows([(noise(20) + passage, 120, 150), (noise(20) + passage, 120, 150)], key)
    rows = [(k, i, i, *r) for i, (k, _, _, *r) in enumerate(rows)]
    held, whole = [], op.build_index
    monkeypatch.setattr(op, "build_index", lambda data, offsets, *least: held.append(len(data)) or whole(data, offsets, *least))
    got = op._shard(rows, op.Settings(shard_bytes=1 << 14)).to_pydict()
    assert len(held) > 5 and max(held) <= 1 << 12
    assert len(got["starts"]) == len(rows) and all(len(s) == 1 and s[0] in (19, 20) for s in got["starts"])
