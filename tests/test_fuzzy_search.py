"""Fuzzy search through its indexes against scoring every pair."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import text
from tidepool.functions.fuzzy import _common, partial_ratio
from tidepool.operators import fuzzy_search as op
from tidepool.plans import memory_plans, tools
from tidepool.sources.memory import memories, now_column, vectors

DATA = "/root/testdata/sf0.001"


def plain_ratio(a, b):
    """Every window aligned."""
    if a is None or b is None:
        return 0.0
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0 if b else 100.0
    return max(windows_ratio(a, b), windows_ratio(b, a) if len(a) == len(b) else 0.0)


def windows_ratio(a, b):
    masks = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    n = len(a)
    windows = (b[max(0, e - n) : e] for e in range(1, len(b) + n))
    return max(200.0 * _common(masks, n, w) / (n + len(w)) for w in windows)


def test_partial_ratio_skips_nothing():
    rnd = random.Random(2)
    for _ in range(1500):
        a, b = ("".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, n))) for n in (14, 40))
        want = plain_ratio(a, b)
        floor = rnd.choice([0.0, 30.0, 60.0, want, max(0.0, want - 1e-7)])
        assert partial_ratio(a, b) == partial_ratio(b, a) == want
        assert partial_ratio(a, b, floor) == max(floor, want)
    assert partial_ratio("x" * 500 + "y", "x" * 3000) == plain_ratio("x" * 500 + "y", "x" * 3000)


def relevance(m, query, valence, arousal):
    best = lambda values: max((partial_ratio(query, v) for v in values or []), default=0.0)
    topic = (3 * partial_ratio(query, m.name) + 2.5 * best(m.domain) + 2 * best(m.tags) + 3 * partial_ratio(query, m.content and m.content[:1000])) / 1050
    near = 0.5 if valence is None or arousal is None else max(0.0, 1 - math.sqrt((valence - (0.5 if m.valence is None else m.valence)) ** 2 + (arousal - (0.3 if m.arousal is None else m.arousal)) ** 2) / 1.414)
    total = (4 * topic + 2 * near + 2.5 * math.exp(-0.1 * m.days) + max(1, min(10, m.importance)) / 10) / 9.5 * 100
    return total * 0.3 if m.resolved else total


def brute(rows, queries, k, at_least):
    live = [m for m in rows if m.store != "archive"]
    out = []
    for asked, query, domains, valence, arousal in queries:
        if not (query or "").strip():
            continue
        wanted = {d.lower() for d in domains or []}
        some = [m for m in live if wanted & {d.lower() for d in m.domain or []}] or live
        scored = [(relevance(m, query, valence, arousal), m.id) for m in some]
        ranked = sorted((-math.floor(r * 100 + 0.5 + 1e-9) / 100, i) for r, i in scored if r >= at_least)[:k]
        out += [(asked, i, -s, n) for n, (s, i) in enumerate(ranked, 1)]
    return sorted(out)


QUERY = "asked_id long, query string, domains array<string>, valence double, arousal double"
ASKED = [
    (1, "doc 7 en", None, None, None), (2, "doc 50 src3", ["EN"], 0.6, 0.4), (3, "eau la que fr", ["fr", "es"], None, None), (4, "unknown domain", ["nowhere"], None, None), (5, "  \t", None, None, None),
    (6, None, None, None, None), (7, "de", [], 0.2, 0.9), (8, "doc " * 30, ["de"], None, None), (9, "a long question about the tion of ing, and whether en or fr was meant by doc 100 in src10", None, 0.5, None), (10, "doc 7 en", ["en", "Fr", "de"], None, None),
]


@pytest.mark.parametrize(("k", "at_least", "first"), [(5, 50.0, 2048), (3, 50.0, 10), (1, 70.0, 40), (400, 50.0, 20)])
def test_equals_scoring_all_pairs(spark, monkeypatch, k, at_least, first):
    for name, value in (("FIRST", first), ("MEMORIES", 37), ("QUERIES", 3)):
        monkeypatch.setattr(op, name, value)
    m = memories(spark, DATA)
    odd = F.col("id") % 19 == 0
    m = m.withColumns({"name": F.when(odd, None).otherwise(F.col("name")), "domain": F.when(odd, None).otherwise(F.col("domain")), "tags": F.when(odd, F.array().cast("array<string>")).otherwise(F.col("tags")), "valence": F.when(odd, None).otherwise(F.col("valence"))}).cache()
    rows, asked = m.collect(), spark.createDataFrame(ASKED, QUERY)
    got = [(r.asked_id, r.id, r.score, r.rank) for r in op.fuzzy_hits(m, asked, k, at_least).collect()]
    want = brute(rows, ASKED, k, at_least)
    assert sorted(got) == want and len({w[0] for w in want}) >= 4
    work = op.fuzzy_cells(m, asked, k, at_least).where("asked_id IS NULL").agg(F.sum("aligned"), F.sum("met")).collect()[0]
    share = work[0] / (len(rows) * len(ASKED) * 4)
    print(f"k={k}, from {at_least}: {work[0]} fields aligned of {len(rows) * len(ASKED) * 4} ({share:.1%}), {work[1]} pairs met of {len(rows) * len(ASKED)}")
    assert k > 5 or share < 0.5


def test_no_memories_and_no_queries(spark):
    m, asked = memories(spark, DATA), spark.createDataFrame(ASKED, QUERY)
    assert op.fuzzy_hits(m.where("false"), asked, 3).count() == op.fuzzy_hits(m, asked.where("false"), 3).count() == 0


def test_merging_falls_back_to_all_domains(spark):
    """A text of an unknown domain, and one without, merge into the best of all memories; a pinned best means no merge."""
    m = memories(spark, DATA).withColumn("pinned", F.lit(False)).withColumn("protected", F.lit(False)).cache()
    rows = m.collect()
    best = max((r for r in rows if r.store != "archive" and not r.resolved), key=lambda r: (r.importance + 25 * math.exp(-0.1 * r.days), -r.id))
    said = f"{best.name} {best.domain[0]} {' '.join(best.tags)} {best.content[:300]}"
    news = [(9001, said, ["nowhere"]), (9002, said, []), (9003, said, None), (9004, said, best.domain), (9005, "zzzz qqqq", ["nowhere"]), (9006, "zzzz qqqq", best.domain)]
    frame = spark.createDataFrame(news, "new_id long, content string, domain array<string>")
    want = brute(rows, [(i, t, d, None, None) for i, t, d in news], 1, 50.0)
    want = {a: (i, s) for a, i, s, _ in want if s > 75}
    got = {r.new_id: (r.id, r.score) for r in tools.merge_targets(m, frame).collect()}
    assert got == want and set(got) >= {9001, 9002, 9003}
    pinned = m.withColumn("pinned", F.col("id") == got[9001][0])
    assert not {9001, 9002} & {r.new_id for r in tools.merge_targets(pinned, frame).collect()}


def test_breath_equals_brute_force(spark):
    """Both channels, what they leave out, packing, mood, drift and touch of whole searches."""
    m, v = memories(spark, DATA).cache(), vectors(spark, DATA)
    rows = {r.id: r for r in m.collect()}
    vecs = {r.id: np.array(r.embedding) for r in v.collect()}
    asked = [(1, "doc 7 en", None, vecs[7].tolist(), 0.9, 0.4), (2, "src3 doc 11", ["en"], None, None, None), (3, "qqq", ["nowhere"], vecs[60].tolist(), None, None)]
    asked += [(100 + i, "zzzz", None, None, None, None) for i in range(40)]
    frame = spark.createDataFrame(asked, "asked_id long, query string, domains array<string>, asked array<double>, valence double, arousal double")
    summaries = {r.id: r.tokens for r in m.select("id", text.token_estimate(memory_plans.summary(F.col("content"))).alias("tokens")).collect()}
    scores = {r.id: r.score for r in memory_plans.with_score(m).collect()}
    got = memory_plans.breath(m, v, frame, max_tokens=700, floor=0.1, seed=4).cache()
    told = got.orderBy("asked_id", "channel", F.desc("score"), "id").collect()
    core = lambda i: bool(rows[i].pinned or rows[i].protected)
    n_drifted = 0
    for a, query, domains, vec, mood, arousal in asked:
        words = [(i, s) for _, i, s, _ in sorted(brute(list(rows.values()), [(a, query, domains, mood, arousal)], 20, 50.0), key=lambda r: r[3]) if not core(i)]
        near = []
        if vec is not None:
            q = np.array(vec)
            best = sorted((-round(float(q @ x / np.sqrt((q @ q) * (x @ x))), 6), i) for i, x in vecs.items())[:20]
            near = [(i, round(-s * 100, 2)) for s, i in best if -s > 0.1 and i in rows and i not in dict(words) and not core(i)]
        want, used = [], 0
        for channel, hits in enumerate((words, near)):
            for i, s in hits:
                if used >= 700 or used + summaries[i] > 700:
                    break
                used += summaries[i]
                shift = 0 if mood is None else (mood - 0.5) * 0.2
                want.append((channel, i, s, round(min(1, max(0, rows[i].valence + shift)), 6), summaries[i], used))
            else:
                continue
            break
        own = [r for r in told if r.asked_id == a]
        assert [(r.channel, r.id, r.score, round(r.valence, 6), r.tokens, r.used) for r in own if r.channel < 2] == want
        drifted = [r for r in own if r.channel == 2]
        n_drifted += bool(drifted)
        assert len(drifted) <= 3 and len({r.id for r in drifted}) == len(drifted) and (not drifted or len(words) + len(near) < 3)
        assert all(scores[r.id] == r.score < 2 and rows[r.id].store != "archive" and r.id not in dict(words + near) for r in drifted)
    assert n_drifted == 0 or 5 <= n_drifted <= 30
    hits = Counter(r.id for r in told if r.channel < 2)
    after = {r.id: r for r in memory_plans.after_breath(m, got, now_column()).collect()}
    assert all(after[i].activation_count >= rows[i].activation_count + n - 0.05 and after[i].last_active == now_column_value(spark) for i, n in hits.items())


def now_column_value(spark):
    return spark.range(1).select(now_column()).collect()[0][0]


def test_memories_are_not_copied_for_groups_of_queries(spark, monkeypatch):
    """Later levels are read once a pass, however many queries there are, and any number of passes finds the same."""
    for name, value in (("FIRST", 10), ("MEMORIES", 37), ("QUERIES", 2)):
        monkeypatch.setattr(op, name, value)
    m, asked = memories(spark, DATA).cache(), spark.createDataFrame(ASKED, QUERY)
    want = brute(m.collect(), ASKED, 3, 50.0)
    for size in (8 << 20, 250):
        monkeypatch.setattr(op, "PASS_BYTES", size)
        assert "Generate" not in op.fuzzy_cells(m, asked, 3, 50.0)._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.asked_id, r.id, r.score, r.rank) for r in op.fuzzy_hits(m, asked, 3, 50.0).collect()) == want
