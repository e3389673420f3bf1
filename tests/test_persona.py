import datetime as dt
import json
import random

from pyspark.sql import functions as F

from tests.oracle import rows as both_sides
from tidepool.functions import answers, scoring
from tidepool.operators import persona
from tidepool.plans import registry, registry_tools  # noqa: F401
from tidepool.streaming import imports, sessions

SCHEMA = "profile_id string, session_id long, event_id long, ts timestamp_ntz, message string, raw string"
DAY = dt.datetime(2024, 1, 1)


def folded(rows, profile):
    traits = dict(persona.START)
    for r in sorted((r for r in rows if r[0] == profile and r[4].strip()), key=lambda r: (r[3], r[2])):
        said = json.loads(r[5]) if r[5].startswith("{") else {}
        for group, most in (("personality_delta", 0.01), ("relationship_delta", 0.03)):
            for k, v in said.get(group, {}).items():
                traits[k] = min(1.0, max(0.0, traits[k] + min(most, max(-most, v))))
    return traits


def test_profiles_equal_a_fold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        # Long drifts one way, so that both bounds are met and left again.
        push = 1 if i // 150 % 2 else -1
        said = {"personality_delta": {"openness": push * 0.01, "neuroticism": rng.uniform(-0.02, 0.01)}, "relationship_delta": {"trust": push * 0.03, "affinity": rng.uniform(-0.05, 0.05)}}
        rows.append((rng.choice(["p", "p", "p", "q"]), i % 7, i, DAY + dt.timedelta(minutes=i // 3), "" if i % 13 == 0 else f"m{i}", "no" if i % 17 == 0 else json.dumps(said)))
    rows.append(("r", 1, 1000, DAY, "hello", "no"))
    log = persona.event_log(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = {r.profile_id: r for r in persona.profiles(log).collect()}
    assert sorted(got) == ["p", "q", "r"]
    for p, row in got.items():
        want = folded(rows, p)
        assert {k: round(row[k], 9) for k in want} == {k: round(v, 9) for k, v in want.items()}, p
    assert got["r"].updated_at == DAY


def test_maps_are_joined_in_order():
    import numpy as np

    steps = np.array([[0.9], [0.9], [-0.3], [-2.0], [0.25]])
    step, low, high = persona._one_map(steps)
    for x in (0.0, 0.4, 1.0):
        want = x
        for d in steps[:, 0]:
            want = min(1.0, max(0.0, want + d))
        assert abs(min(high[0], max(low[0], x + step[0])) - want) < 1e-12


def test_log_of_nulls_and_nothing(spark):
    rows = [(None, 1, 1, DAY, "hi", None), ("p", 1, 2, DAY, None, "{}"), ("p", 1, 3, DAY, "hi", "```json\n{\"confidence\": 7}\n```")]
    log = persona.event_log(spark.createDataFrame(rows, SCHEMA))
    listed = {r.event_id: r for r in persona.listed_events(log).collect()}
    assert sorted(listed) == [1, 3]
    assert (listed[1].error, listed[1].event_type, listed[1].confidence) == (persona.NO_ANSWER, "unknown", 0.0)
    assert (listed[3].error, listed[3].event_type, listed[3].confidence) == ("", "neutral", 1.0)
    assert {r.profile_id: r.trust for r in persona.profiles(log).collect()} == {None: 0.82, "p": 0.82}
    assert persona.profiles(log.limit(0)).count() == 0


def test_state_block(spark):
    state = spark.range(1).select(*[F.lit(v).alias(k) for k, v in persona.START.items()], F.lit("p").alias("profile_id"), F.lit(1).alias("session_id"), F.lit(0.5).alias("valence"), F.lit(0.25).alias("arousal"), F.lit(0.4).alias("session_defensiveness"), F.lit(None).cast("string").alias("mood_label"), F.lit("").alias("reply_guidance"))
    lines = persona.state_blocks(state).collect()[0].block.split("\n")
    assert lines[0] == "Current Inner State" and lines[4] == f"Reply Guidance: {persona.STEADY}"
    assert lines[2] == "Affect: valence=0.500, arousal=0.250, mood_label=warm_neutral"
    assert lines[3] == "Relationship: affinity=0.860, dominance=0.380, defensiveness=0.400, trust=0.820"


def test_import_status(spark):
    planned = spark.createDataFrame([(s, f"{s}{i}", i) for s in "abcd" for i in range(3)], "source_hash string, chunk_id string, chunk int")
    schema = "chunk_id string, api_calls int, created int, merged int, raw int, error string"
    done = [(f"a{i}", 1, 2, 1, 0, None) for i in range(3)] + [("a0", 1, 2, 1, 0, None), ("b0", 1, 0, 0, 0, "x" * 300), ("b1", 1, 0, 0, 0, "y"), ("c0", 1, 5, 0, 5, None)]
    outcomes, paused = spark.createDataFrame(done, schema), spark.createDataFrame([("a",), ("c",)], "source_hash string")
    got = {r.source_hash: r for r in imports.import_status(planned, outcomes, paused, 1).collect()}
    assert {k: (r.status, r.processed, r.memories_created, r.memories_merged, r.memories_raw) for k, r in got.items()} == {"a": ("completed", 3, 6, 3, 0), "b": ("running", 2, 0, 0, 0), "c": ("paused", 1, 5, 0, 5), "d": ("idle", 0, 0, 0, 0)}
    assert got["b"].errors == ["Chunk 0: " + "x" * 200] and got["a"].errors == []
    assert sorted(r.chunk_id for r in imports.pending_chunks(planned, outcomes, paused).collect()) == ["b2", "d0", "d1", "d2"]


def test_rounding_of_four_places_to_three(spark):
    import duckdb

    values = [i / 10_000 for i in range(10_001)]
    want = [r[0] for r in duckdb.sql("SELECT round(i::DOUBLE / 10000, 3) FROM range(10001) t(i) ORDER BY i").fetchall()]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scoring.scaled_round(F.col("v"), 3).alias("r")).orderBy("i").collect()
    assert [(i, r.r) for i, r in enumerate(got) if r.r != want[i]] == []


def test_snapshot_of_many_sessions_equals_its_sql(spark):
    got, want = both_sides(spark, "persona_snapshot", registry.QUERIES["persona_snapshot"], registry.ORACLES["persona_snapshot"], "/root/testdata/sf0.1")
    assert [p for p in zip(got, want, strict=True) if p[0] != p[1]] == []


def test_an_answer_is_parsed_once(spark):
    log = persona.event_log(spark.createDataFrame([("p", 1, 1, DAY, "hi", "{}")], SCHEMA).repartition(2))
    plan = log._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get") == 1 and plan.count("parse_json") + plan.count("parseJson") <= 1


def test_odd_answers(spark):
    said = ['{"confidence": "x"}', '{"confidence": {"a": 1}}', '{"affect_delta": 3}', '{"affect_delta": {"valence": "NaN", "arousal": 9}}', '{"affect_delta": {"valence": null, "arousal": {}}}', '{"event_type": [1], "mood_label": 5}', "[1]", "no", '{"a": 1, "a": 2}']
    got = spark.createDataFrame(list(enumerate(said)), "i int, raw string").select("i", answers.evaluation(F.col("raw")).alias("e")).orderBy("i").collect()
    e = [r.e for r in got]
    assert [x.confidence for x in e[:2]] == [0.0, 0.0]
    assert [(x.affect_delta.valence, x.affect_delta.arousal) for x in e[2:5]] == [(0.0, 0.0), (-0.18, 0.18), (0.0, -0.18)]
    assert (e[5].event_type, e[5].mood_label, e[5].confidence) == ("[1]", "5", 0.5) and e[6:] == [None, None, None]


def test_last_moods_are_the_last_of_all_moods(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), i, DAY + dt.timedelta(seconds=rng.randrange(90_000)), rng.uniform(-0.3, 0.3), rng.choice([None, 0.1]), 0.0, rng.choice([None, f"l{i}"])) for i in range(400)] + [(9, 1, DAY, 0.0, 0.0, 0.0, None)]
    events = spark.createDataFrame(rows, "session_id long, event_id long, ts timestamp_ntz, d_valence double, d_arousal double, d_defensiveness double, mood_label string").repartition(5)
    last = {r[0]: r[:3] for r in sorted(rows, key=lambda r: (r[2], r[1]))}
    labels = {r[0]: r[6] for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[6]}
    want = {r.session_id: r for r in sessions.moods(events).collect() if r.event_id == last[r.session_id][1]}
    got = {r.session_id: r for r in sessions.last_moods(events).collect()}
    assert sorted(got) == sorted(want) == [0, 1, 2, 3, 9]
    for k, r in got.items():
        assert (round(r.valence, 4), round(r.arousal, 4), round(r.session_defensiveness, 4)) == (want[k].valence, want[k].arousal, want[k].defensiveness)
        assert r.mood_label == labels.get(k)
    assert "mood_label" not in sessions.last_moods(events.drop("mood_label")).columns
    assert sessions.last_moods(events.limit(0)).count() == 0


def test_profiles_of_messages_are_those_of_their_log(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["p", None]), 1, i, DAY + dt.timedelta(minutes=i // 2), rng.choice(["hi", " ", None]), rng.choice(["no", None, '{"personality_delta": {"openness": -0.01}}'])) for i in range(120)] + [("r", 1, 999, DAY, "hi", "no"), ("s", 1, 1000, DAY, " ", "no")]
    said = spark.createDataFrame(rows, SCHEMA).repartition(3)
    key = lambda df: sorted((str(r.profile_id), round(r.openness, 9), r.trust, r.updated_at) for r in df.collect())
    assert key(persona.profiles_of(said)) == key(persona.profiles(persona.event_log(said)))
    assert [x[0] for x in key(persona.profiles_of(said))] == ["None", "p", "r"]
