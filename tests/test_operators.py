"""Properties of operators on small inputs, and edge rows."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidepool.functions.text import token_estimate
from tidepool.operators import packing, pairs, pivots, predicates, ranking, turns, writes
from tidepool.plans import registry, tools
from tidepool.sources.memory import memories, now_column, rounds, turns as turn_table, vectors

DATA = "/root/testdata/sf0.001"


def test_pack_stops_at_the_first_that_does_not_fit(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([5, 0, 4, 100, 1, 0])], "id int, tokens int")
    take = lambda b: [r.id for r in packing.pack(rows, F.lit(b), [F.col("id")]).orderBy("id").collect()]
    assert take(9) == [0, 1, 2] and take(10) == [0, 1, 2] and take(109) == [0, 1, 2, 3] and take(0) == [] and take(4) == [] and take(1000) == [0, 1, 2, 3, 4, 5]


def test_trim_fits(spark):
    text = " ".join(["word"] * 400)
    got = spark.range(1).select(packing.trim(F.lit(text), F.lit(50)).alias("t"), packing.trim(F.lit(text), F.lit(0)).alias("none"), packing.trim(F.lit("ok"), F.lit(50)).alias("same")).select("*", token_estimate(F.col("t")).alias("n")).collect()[0]
    assert 30 < got.n <= 50 and text.startswith(got.t) and got.none == "" and got.same == "ok"


def test_similar_pairs_in_any_blocks(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, []), (101, None), (102, [0.0] * 4), (103, [1.0, 2.0])]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    want = {(a, b) for a, x in rows[:60] for b, y in rows[:60] if a < b and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) > 0.5}
    for blocks in (1, 3, 7):
        assert {(r.source, r.target) for r in pairs.similar_pairs(v, 0.5, blocks).collect()} == want


def test_nearest_by_pivots_equals_the_full_scan(spark, monkeypatch):
    """Vectors in clumps, where pivots rule most out, and spread ones, where they can't."""
    monkeypatch.setattr(pivots, "SHARE", 40)
    rng = np.random.default_rng(4)
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    centres = rng.normal(size=(12, 16))
    clumped = [c + rng.normal(size=16) * 0.05 for c in centres for _ in range(60)]
    for vecs, most in ((clumped, 0.35), (list(rng.normal(size=(300, 8))), 1.0), ([*clumped[:5], *clumped[:5], -clumped[0], clumped[0] * 3], 1.0)):
        rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(9000, None), (9001, []), (9002, [0.0] * len(vecs[0])), (9003, [1.0, 2.0]), (9004, [2.0, 1.0])]
        v = spark.createDataFrame(rows, "id long, embedding array<double>")
        asked = [(i, vecs[i].tolist()) for i in range(0, len(vecs), 5)] + [(9000, None), (9002, [0.0] * len(vecs[0])), (9003, [1.0, 2.0]), (9005, [1.0])]
        q = spark.createDataFrame(asked, "asked_id long, asked array<double>")
        for k in (7,):
            want = []
            for a, x in asked:
                if x and any(x):
                    scores = sorted((-cos(np.array(x), np.array(y)), i) for i, y in rows if y and any(y) and len(y) == len(x))[:k]
                    want += [(a, i, -s) for s, i in scores]
            got = sorted((r.asked_id, r.id, r.similarity) for r in pivots.nearest_by_pivots(v, q, k).collect())
            assert got == sorted(want)
        share = pivots.compared(v, q, 7).agg(F.sum("compared")).collect()[0][0] / (len(asked) * len(rows))
        print(f"{share:.1%} of pairs compared")
        assert share <= most


def test_within_hours_equals_naive(spark):
    rnd = random.Random(1)
    times = [rnd.randrange(0, 500 * 3600) for _ in range(80)]
    m = spark.createDataFrame(list(enumerate(times)), "id long, s long").select("id", F.col("id").alias("seq"), F.timestamp_add("SECOND", F.col("s").cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created"))
    got = [(r.source, r.target) for r in pairs.within_hours(m, m, 48).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in range(80) for b in range(80) if a != b and abs(times[a] - times[b]) <= 48 * 3600}


def test_first_within_equals_naive(spark):
    rnd = random.Random(2)
    times = [rnd.choice([rnd.randrange(0, 40 * 3600), rnd.randrange(0, 200), 7200, 14399, 14400]) for _ in range(150)]
    seq = [rnd.randrange(0, 100) for _ in times]
    stamp = F.timestamp_add("SECOND", F.col("s").cast("int"), F.lit("1969-12-31 20:00:00").cast("timestamp_ntz"))
    m = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(zip(seq, times, strict=True))] + [(900, 0, None)], "id long, seq long, s long").withColumn("created", stamp)
    for hours in (1, 3):
        got = {(r.source, r.nth): (r.target, round(r.gap_hours * 3600)) for r in pairs.first_within(m.where("id % 2 = 0"), m, hours, 3).collect()}
        want = {}
        for a in range(0, 150, 2):
            near = sorted((seq[b], b) for b in range(150) if b != a and abs(times[a] - times[b]) <= hours * 3600)[:3]
            want |= {(a, n): (b, abs(times[a] - times[b])) for n, (_, b) in enumerate(near, 1)}
        assert got == want


def test_leader_clusters_are_greedy(spark):
    rnd = random.Random(3)
    edges = sorted({tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)})
    near = {i: {b for a, b in edges if a == i} for i in range(40)}
    claimed, want = set(), {}
    for i in range(40):
        if i not in claimed:
            own = [i] + sorted(near[i] - claimed)
            claimed.update(own)
            want[i] = own
    got: dict = {}
    for r in pairs.leader_clusters(spark.createDataFrame(edges, "source long, target long"), spark.range(40)).collect():
        got.setdefault(r.leader, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == want


def test_a_chain_is_settled_in_as_many_rounds_as_ranges(spark):
    """10 000 rows, each like the next one only: every second one leads."""
    n = 10_000
    chain = spark.range(n - 1).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    for rows, most in ((500_000, 1), (2600, 5)):
        state, rounds = pairs.leaders(chain, spark.range(n), rows)
        got = sorted(map(tuple, state.collect()))
        assert got == [(i, i % 2 == 0) for i in range(n)] and rounds <= most


def test_leaders_in_small_ranges(spark):
    rnd = random.Random(8)
    edges = sorted({tuple(sorted(rnd.sample(range(300), 2))) for _ in range(700)})
    want: dict[int, bool] = {}
    for i in range(300):
        want[i] = not any(want[a] for a, b in edges if b == i)
    state, rounds = pairs.leaders(spark.createDataFrame(edges + edges[:5], "source long, target long"), spark.range(300), 40)
    assert dict(map(tuple, state.collect())) == want and rounds < 18
    assert pairs.leaders(spark.createDataFrame([], "source long, target long"), spark.range(3))[0].where("leads").count() == 3


def test_chunks_lose_nothing(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", " ".join(["w"] * ((7 * c + 13 * t) % 90 + (300 if t == 3 else 0)))) for c in range(5) for t in range(12)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turns.chunks(table, 100).orderBy("conv_id", "chunk").collect()
    for c in range(5):
        own = [r for r in got if r.conv_id == c]
        assert "\n".join(r.content for r in own) == "\n".join(f"[{'用户' if role == 'user' else 'AI'}] {text}" for x, _, role, text in rows if x == c)
        assert all(r.tokens <= 100 or r.turn_count == 1 for r in own)


def test_rare_values(spark):
    m = memories(spark, DATA).limit(3).withColumn("type", F.lit(None).cast("string")).withColumn("pinned", F.lit(None).cast("boolean")).withColumn("resolved", F.lit(None).cast("boolean")).withColumn("protected", F.lit(None).cast("boolean"))
    flags = m.select(predicates.can_surface().alias("a"), predicates.is_core().alias("b"), predicates.can_be_recalled().alias("c"), predicates.in_patterns().alias("d")).distinct().collect()
    assert [tuple(r) for r in flags] == [(True, False, True, False)]


def test_snapshots_keep_their_columns(spark):
    m = memories(spark, DATA)
    some = m.where("id < 5")
    for after in (writes.deleted(m, some), writes.archived(m, some), writes.updated(m, some.select("id", F.lit(3).alias("importance")), now_column()), writes.touched(m, some.select("id"), now_column()), writes.reviewed(m, some.select("id", F.lit("pin").alias("action")), now_column())):
        assert after.columns == m.columns
    assert writes.deleted(m, some.unionAll(some)).count() == m.count() - 5


def test_pinning_wins_over_resolving(spark):
    m = memories(spark, DATA).where("type = 'dynamic' AND NOT pinned AND NOT protected").limit(2)
    a, b = (r.id for r in m.collect())
    both = writes.updated(m, m.select("id", (F.col("id") == a).alias("pinned"), F.lit(True).alias("resolved"), F.lit("a/b?").alias("name"), F.lit(4).alias("importance")), now_column())
    got = {r.id: (r.type, r.store, r.pinned, r.resolved, r.name, r.importance) for r in both.collect()}
    assert got == {a: ("permanent", "permanent", True, True, "ab", 10), b: ("archived", "archive", False, True, "ab", 4)}


def test_source_of_a_feeling_is_digested(spark):
    m = memories(spark, DATA).where("NOT digested").limit(3)
    a, b, c = (r.id for r in m.collect())
    kinds = "new_id long, content string, domain array<string>, tags array<string>, valence double, arousal double, importance int, pinned boolean, type string, source long"
    news = spark.createDataFrame([(9001, "x", [], [], 0.25, 0.5, 5, False, "feel", a), (9002, "y", [], [], -1.0, 0.5, 5, False, "feel", b), (9003, "z", [], [], 0.5, 0.5, 5, True, "dynamic", c)], kinds)
    after, _ = tools.hold(m, news, now_column())
    got = {r.id: (r.digested, r.model_valence) for r in after.where("id < 9000").collect()}
    assert got == {a: (True, 0.25), b: (True, None), c: (False, None)}


def test_cards_and_fallback(spark):
    rows = [("a", 1, 0.9), ("a", 2, 0.8), ("a", 3, 0.7), ("b", 1, 0.9), ("b", 2, 0.7), ("c", 1, 0.54), ("d", 1, 0.6), ("d", 2, 0.52)]
    c = spark.createDataFrame(rows, "session_id string, id long, score double")
    assert sorted((r.session_id, r.id) for r in ranking.cards(c).collect()) == [("a", 1), ("a", 2), ("b", 1), ("d", 1), ("d", 2)]
    recent = spark.createDataFrame([("a", 1), ("c", 1)], "session_id string, id long")
    left = {(r.session_id, r.id) for r in ranking.unless_recent(c, recent).collect()}
    assert ("a", 1) not in left and ("c", 1) in left and len(left) == 7


def test_searches_meet_all_memories(spark, monkeypatch):
    """Both channels of the recall against brute force over every memory and vector."""
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 7)
    split = lambda x: set(re.findall(r"[^\W_]+", (x or "").lower()))
    sessions = {r.session_id for r in rounds(spark, DATA).select("session_id").distinct().collect()}
    asked = {r.conv_id: r.query for r in turns.last_messages(turn_table(spark, DATA)).collect() if r.query is not None and r.conv_id in sessions}
    held = {r.id: split(r.content) for r in memories(spark, DATA).where(predicates.can_be_recalled()).collect()}
    vecs = {r.id: np.array(r.embedding) for r in vectors(spark, DATA).collect()}
    cos = lambda a, b: round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
    best = lambda scores: sorted(((-s, i) for i, s in scores.items()))[:10]
    words, near = registry._searches(spark, DATA)
    got = lambda df: sorted((r.session_id, -round(r.score, 6), r.id) for r in df.collect())
    want = [(c, round(s, 6), i) for c, q in asked.items() for s, i in best({i: len(split(q) & w) / len(split(q)) for i, w in held.items() if split(q) & w})]
    assert len(want) > 50 and got(words) == sorted(want)
    want = [(c, s, i) for c in asked if c in vecs for s, i in best({i: cos(vecs[c], v) for i, v in vecs.items()})]
    assert len(want) > 50 and got(near) == sorted(want)
    met = near.collect()
    assert any(r.session_id % 20 != r.id % 20 for r in met)


def test_merge_targets_of_many_news(spark):
    m = memories(spark, DATA)
    same = m.where("store = 'dynamic' AND NOT pinned AND NOT protected AND NOT resolved").orderBy(F.desc("importance"), "days", "id").limit(1)
    news = same.select(F.explode(F.expr("array(9001L, 9002L, 9003L)")).alias("new_id"), F.left("content", F.lit(200)).alias("content"), "domain")
    got = [r.new_id for r in tools.merge_targets(m, news).collect()]
    assert sorted(got) == [9001, 9002, 9003]


def test_hold_and_grow(spark):
    m = memories(spark, DATA)
    same = m.where("store = 'dynamic' AND NOT pinned AND NOT protected AND NOT resolved").orderBy(F.desc("importance"), "days", "id").limit(1).select("id", "content", "domain").collect()[0]
    news = spark.createDataFrame(
        [(9001, same.content[:200], same.domain, ["t"], 0.5, 0.5, 3, False, "dynamic"), (9002, "zzzzqqqq", ["nowhere"], [], 0.5, 0.5, 3, False, "dynamic"), (9003, same.content[:200], same.domain, [], 0.5, 0.5, 3, True, "dynamic"), (9004, "felt", [], [], 0.5, 0.5, 3, False, "feel")],
        "new_id long, content string, domain array<string>, tags array<string>, valence double, arousal double, importance int, pinned boolean, type string",
    )
    after, outcome = tools.hold(m, news, now_column())
    how = {r.new_id: r.outcome for r in outcome.collect()}
    assert how[9002] == how[9003] == how[9004] == "created" and set(how.values()) <= {"created", "merged"}
    assert after.count() == m.count() + sum(v == "created" for v in how.values())
    made = {r.id: r for r in after.where("id > 9000").collect()}
    assert (made[9003].store, made[9003].importance, made[9004].store, made[9004].domain) == ("permanent", 10, "feel", ["未分类"])
    diary = spark.createDataFrame([(1, "short one", None), (2, "a longer entry " * 5, '[{"content": "x"}, {"content": "y", "tags": ["t"]}]'), (3, "another long entry " * 5, "broken")], "diary_id long, text string, answer string")
    assert [(r.new_id, r.content) for r in tools.grown(diary, 0).orderBy("new_id").collect()] == [(1000, "short one"), (2000, "x"), (2001, "y")]


def test_searches_in_passes_copy_no_rows(spark, monkeypatch):
    """Queries in one pass and in several, with ties, odd vectors and fewer rows than asked for; rows go to no cells."""
    rng = np.random.default_rng(8)
    vecs = [rng.integers(-1, 2, size=4).astype(float).tolist() for _ in range(90)] + [None, [], [1.0, 2.0]]
    v = spark.createDataFrame(list(enumerate(vecs)), "id long, embedding array<double>").repartition(3)
    q = v.where("id % 4 = 0 OR id > 88").select(F.col("id").alias("asked_id"), F.col("embedding").alias("asked"))
    cos = lambda a, b: round(float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 6) + 0.0 if a and b and len(a) == len(b) and any(a) and any(b) else 0.0
    near = sorted((a, i, -s) for a in range(93) if a % 4 == 0 or a > 88 for s, i in sorted((-cos(vecs[a], y), i) for i, y in enumerate(vecs))[:7])
    lists = [rng.choice(40, size=rng.integers(0, 12), replace=False).tolist() for _ in range(80)]
    held = spark.createDataFrame([(i, [f"w{x}" for x in words] or None) for i, words in enumerate(lists)], "id long, words array<string>").repartition(3)
    asks = held.where("id % 5 = 0").select(F.col("id").alias("asked_id"), F.col("words").alias("asked"))
    shared = sorted((a, i, n / len(lists[a])) for a in range(0, 80, 5) for n, i in [(-m, i) for m, i in sorted((-len(set(lists[a]) & set(x)), i) for i, x in enumerate(lists)) if m][:6])
    for bytes_at_once in (1 << 20, 300):
        monkeypatch.setattr(pairs, "PASS_BYTES", bytes_at_once)
        found = pairs.nearest_each(v, q, 7)
        assert sorted((r.asked_id, r.id, r.similarity + 0.0) for r in found.collect()) == [(a, i, s + 0.0) for a, i, s in near]
        assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.asked_id, r.id, r.score) for r in pairs.most_shared(held, asks, 6).collect()) == shared
    assert pairs.nearest_each(v, q.limit(0), 3).count() == pairs.nearest_each(v.limit(0), q, 3).count() == 0


def test_clusters_of_vectors_need_no_pairs(spark, monkeypatch):
    """The same clusters as through pairs, in one round and in many, with vectors that are near none."""
    rng = np.random.default_rng(9)
    vecs = [rng.normal(size=3).tolist() for _ in range(120)] + [None, [], [0.0] * 3, [1.0, 2.0], [2.0, 1.0]]
    v = spark.createDataFrame(list(enumerate(vecs)), "id long, embedding array<double>").repartition(3)
    want = sorted(map(tuple, pairs.leader_clusters(pairs.similar_pairs(v, 0.8).select("source", "target"), v).collect()))
    assert len({a for a, _ in want}) > 10
    for rows in (4096, 6):
        monkeypatch.setattr(pairs, "LED_ROWS", rows)
        assert sorted(map(tuple, pairs.vector_clusters(v, 0.8).collect())) == want
    assert pairs.vector_clusters(v.limit(0), 0.8).count() == 0


def test_pairs_of_large_blocks_are_all_pairs(spark, monkeypatch):
    """Numbers that four bytes don't hold, several tiles a cell, and no more cells than blocks of PAIR_ROWS need."""
    rng = np.random.default_rng(10)
    vecs = [rng.normal(size=5).tolist() for _ in range(150)]
    v = spark.createDataFrame(list(enumerate(vecs)), "id long, embedding array<double>").repartition(3)
    m = np.array(vecs) / np.linalg.norm(vecs, axis=1)[:, None]
    want = {(a, b): round(float(m[a] @ m[b]), 9) for a in range(150) for b in range(a + 1, 150) if m[a] @ m[b] > 0.4}
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 11)
    for rows, blocks in ((10_000, 2), (60, 3)):
        monkeypatch.setattr(pairs, "PAIR_ROWS", rows)
        monkeypatch.setattr(pairs, "PAIR_BLOCKS", 2)
        found = pairs.similar_pairs(v, 0.4)
        assert {(r.source, r.target): round(r.similarity, 9) for r in found.collect()} == want
        assert found.rdd.getNumPartitions() == blocks * (blocks + 1) // 2


def test_a_record_without_content_is_broken(spark):
    """As the reference's check has it: name, domain or content missing; the SQL of broken_rows knows the first two only."""
    rows = [(1, "n", ["d"], "c"), (2, "", ["d"], "c"), (3, None, ["d"], "c"), (4, "n", [], "c"), (5, "n", None, "c"), (6, "n", ["d"], ""), (7, "n", ["d"], None), (8, "n", [None], " ")]
    got = spark.createDataFrame(rows, "id long, name string, domain array<string>, content string").select("id", predicates.is_broken().alias("broken")).orderBy("id").collect()
    assert [r.broken for r in got] == [False, True, True, True, True, True, True, False]
