"""Queries of tools, sessions, payloads and sources; importing this module registers them."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.functions import answers, messages, scoring, text
from tidepool.operators import persona, writes
from tidepool.plans import sql, tools
from tidepool.plans.registry import MEM, query
from tidepool.sources import markdown
from tidepool.sources.memory import memories, now_column
from tidepool.sources.memory import turns as turn_table
from tidepool.streaming import imports, sessions

#: Fixed values of the test events: how each type moves a mood.
DELTAS = {"click": (0.02, 0.01), "view": (0.0, 0.0), "purchase": (0.05, 0.05), "error": (-0.10, 0.10), "signup": (0.20, 0.05)}


def mood_events(spark, d):
    pick = lambda i: F.coalesce(*[F.when(F.col("event_type") == k, v[i]) for k, v in DELTAS.items()], F.lit(0.0))
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), pick(0).alias("d_valence"), pick(1).alias("d_arousal"), F.lit(0.0).alias("d_defensiveness"))


def _drift(name: str, rest: float) -> str:
    return f"CASE WHEN m <= 0 THEN f.{name} ELSE {rest}::DOUBLE + (f.{name} - {rest}::DOUBLE) * pow(0.5::DOUBLE, m / 90) END"


def _pick(i: int) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v[i]}::DOUBLE" for k, v in DELTAS.items())
    return f"greatest(-0.18::DOUBLE, least(0.18::DOUBLE, CASE event_type {cases} ELSE 0 END))"


MOODS = f"""
WITH RECURSIVE ev AS (SELECT user_id AS session_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, {_pick(0)} AS dv, {_pick(1)} AS da FROM events),
f AS (SELECT session_id, event_id, ts, n, greatest(0, least(1, 0.56::DOUBLE + dv)) AS valence, greatest(0, least(1, 0.34::DOUBLE + da)) AS arousal, 0.12::DOUBLE AS defensiveness FROM ev WHERE n = 1
  UNION ALL SELECT session_id, event_id, ts, n, greatest(0, least(1, v + dv)), greatest(0, least(1, a + da)), 0.12::DOUBLE
  FROM (SELECT e.*, {_drift('valence', 0.56)} AS v, {_drift('arousal', 0.34)} AS a FROM (SELECT f.*, e.event_id AS e_id, e.ts AS e_ts, e.n AS e_n, e.dv AS e_dv, e.da AS e_da, (epoch_us(e.ts) - epoch_us(f.ts))::DOUBLE / 60000000 AS m FROM f JOIN ev e ON e.session_id = f.session_id AND e.n = f.n + 1) f, LATERAL (SELECT f.session_id AS session_id, f.e_id AS event_id, f.e_ts AS ts, f.e_n AS n, f.e_dv AS dv, f.e_da AS da) e))
"""


@query("session_moods", MOODS + "SELECT session_id, event_id, round(valence, 4) AS valence, round(arousal, 4) AS arousal, round(defensiveness, 4) AS defensiveness FROM f")
def session_moods(spark, d):
    return sessions.moods(mood_events(spark, d))


@query("persona_snapshot", MOODS + ", l AS (SELECT session_id, arg_max(round(valence, 4), n) AS valence, arg_max(round(arousal, 4), n) AS arousal FROM f GROUP BY 1) SELECT session_id, round(valence, 3) AS valence, round(arousal, 3) AS arousal, greatest(0.12::DOUBLE, 0.3::DOUBLE) AS defensiveness, 'V' || printf('%.3f', round(valence, 3)) || ' A' || printf('%.3f', round(arousal, 3)) AS line FROM l")
def persona_snapshot(spark, d):
    """The last mood of each session, kept to four places; defensiveness is the larger of the session's and the profile's."""
    last = sessions.last_moods(mood_events(spark, d))
    v, a = (scoring.scaled_round(scoring.scaled_round(F.col(c), 4), 3) for c in ("valence", "arousal"))
    return last.select("session_id", v.alias("valence"), a.alias("arousal"), F.greatest(F.round("session_defensiveness", 3), F.lit(0.3)).alias("defensiveness"), F.concat(F.lit("V"), F.format_string("%.3f", v), F.lit(" A"), F.format_string("%.3f", a)).alias("line"))


#: Fixed values of the test answers: what a model says of each type of event, before limits; a view's answer is broken.
SAID = {
    "click": {"affect_delta": {"valence": 0.02, "arousal": 0.01}, "relationship_delta": {"affinity": 0.01, "trust": 0.005}, "personality_delta": {"openness": 0.004, "neuroticism": -0.002}},
    "purchase": {"affect_delta": {"valence": 0.05, "arousal": 0.05}, "relationship_delta": {"affinity": 0.05, "trust": 0.02}, "personality_delta": {"agreeableness": 0.02}},
    "error": {"affect_delta": {"valence": -0.1, "arousal": 0.1}, "relationship_delta": {"affinity": -0.02, "defensiveness": 0.04, "trust": -0.05}, "personality_delta": {"neuroticism": 0.01, "agreeableness": -0.01}},
    "signup": {"affect_delta": {"valence": 0.2, "arousal": 0.05}, "relationship_delta": {"dominance": -0.01, "defensiveness": -0.02}, "personality_delta": {"extraversion": 0.01, "openness": -0.004}},
}
_LIMITS = {"affect_delta": 0.18, "relationship_delta": 0.03, "personality_delta": 0.01}


def persona_messages(spark, d):
    """Events as messages to three profiles with a model's answer; every eleventh is empty."""
    answer = lambda k, v: F.lit(json.dumps({"event_type": k, "mood_label": f"after {k}", "confidence": 0.8, **v}))
    raw = F.coalesce(*[F.when(F.col("event_type") == k, answer(k, v)) for k, v in SAID.items()], F.lit("sorry"))
    message = F.when(F.col("event_id") % 11 != 0, F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).otherwise("  ")
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("profile_id"), F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), message.alias("message"), raw.alias("raw"))


def _said(group: str, trait: str) -> str:
    most = _LIMITS[group]
    cases = "".join(f" WHEN event_type = '{k}' THEN {max(-most, min(most, v[group].get(trait, 0.0)))}::DOUBLE" for k, v in SAID.items())
    return f"CASE WHEN event_id % 11 = 0 THEN 0::DOUBLE{cases} ELSE 0::DOUBLE END"


_TRAITS = {k: ("personality_delta" if k in answers.PERSONALITY else "relationship_delta") for k in persona.START}
_HELD = lambda x: f"greatest(0::DOUBLE, least(1::DOUBLE, {x}))"
_FOLDS = ", ".join(f"list_reduce([{v}::DOUBLE] || list({_said(_TRAITS[k], k)} ORDER BY ts, event_id), lambda a, x: {_HELD('a + x')}) AS {k}" for k, v in persona.START.items())
PROFILES = f"profiles AS (SELECT 'p' || (user_id % 3) AS profile_id, {_FOLDS}, coalesce(max(ts) FILTER (WHERE event_type IN ('click', 'purchase', 'error', 'signup')), min(ts)) AS updated_at FROM events WHERE event_id % 11 <> 0 GROUP BY 1)"


@query("persona_profiles", f"WITH {PROFILES} SELECT profile_id, {', '.join(f'round({k}, 4) AS {k}' for k in persona.START)}, updated_at FROM profiles")
def persona_profiles(spark, d):
    """Each profile after all messages of all its sessions."""
    p = persona.profiles_of(persona_messages(spark, d))
    return p.select("profile_id", *[F.round(k, 4).alias(k) for k in persona.START], "updated_at")


@query("persona_events", f"SELECT event_id, session_id, left(sha256(event_type || ' ' || event_id), 12) AS message_hash, CASE WHEN known THEN event_type ELSE 'unknown' END AS event_type, CASE WHEN known THEN 'after ' || event_type ELSE '' END AS mood_label, CASE WHEN known THEN 0.8 ELSE 0 END::DOUBLE AS confidence, CASE WHEN known THEN {_said('affect_delta', 'valence')} END AS valence, CASE WHEN known THEN {_said('relationship_delta', 'trust')} END AS trust, CASE WHEN known THEN '' ELSE '{persona.NO_ANSWER}' END AS error, ts FROM (SELECT *, user_id AS session_id, event_type IN ('click', 'purchase', 'error', 'signup') AS known FROM events) WHERE event_id % 11 <> 0 ORDER BY event_id DESC LIMIT 100")
def persona_events(spark, d):
    """The newest hundred events of the log."""
    listed = persona.listed_events(persona.event_log(persona_messages(spark, d)), 100)
    return listed.select("event_id", "session_id", "message_hash", "event_type", "mood_label", "confidence", F.col("affect_delta.valence").alias("valence"), F.col("relationship_delta.trust").alias("trust"), "error", "ts")


_AT = lambda k, rest: f"'{k}': " + _HELD(_HELD(f"{rest}::DOUBLE + (acc.{k} - {rest}::DOUBLE) * pow(0.5::DOUBLE, (nxt.t - acc.t) / 90)") + f" + nxt.{k}")
_REST = sessions.REST
BLOCKS = f"""WITH {PROFILES}, said AS (SELECT user_id, event_id, ts, epoch_us(ts)::DOUBLE / 60000000 AS t, {_said('affect_delta', 'valence')} AS v, {_said('affect_delta', 'arousal')} AS a, {_said('relationship_delta', 'defensiveness')} AS s, CASE WHEN event_id % 11 <> 0 AND event_type IN ('click', 'purchase', 'error', 'signup') THEN 'after ' || event_type END AS label FROM events),
moods AS (SELECT user_id, list_reduce([{{'valence': {_REST['valence']}::DOUBLE, 'arousal': {_REST['arousal']}::DOUBLE, 'defensiveness': {_REST['defensiveness']}::DOUBLE, 't': min(t)}}] || list({{'valence': v, 'arousal': a, 'defensiveness': s, 't': t}} ORDER BY ts, event_id), lambda acc, nxt: {{{', '.join(_AT(k, r) for k, r in _REST.items())}, 't': nxt.t}}) AS m, coalesce(last(label ORDER BY ts, event_id) FILTER (WHERE label IS NOT NULL), 'warm_neutral') AS label FROM said GROUP BY 1)
SELECT profile_id, user_id AS session_id, 'Current Inner State' || chr(10) || 'Personality: ' || {" || ', ' || ".join(f"printf('{k}=%.3f', round({k}, 3))" for k in answers.PERSONALITY)} || chr(10) || printf('Affect: valence=%.3f, arousal=%.3f, mood_label=', round(m.valence, 3), round(m.arousal, 3)) || label || chr(10) || printf('Relationship: affinity=%.3f, dominance=%.3f, defensiveness=%.3f, trust=%.3f', round(affinity, 3), round(dominance, 3), round(greatest(defensiveness, m.defensiveness), 3), round(trust, 3)) || chr(10) || 'Reply Guidance: {persona.STEADY}' AS block
FROM moods JOIN profiles ON profile_id = 'p' || (user_id % 3)"""


@query("persona_blocks", BLOCKS)
def persona_blocks(spark, d):
    """The text block of each session: its mood after its last message, beside its profile."""
    said = persona_messages(spark, d)
    last = sessions.last_moods(persona.mood_events(said))  # empty messages have no event but let the mood drift
    owners = said.select("profile_id", "session_id").distinct()
    states = owners.join(last, "session_id").join(persona.profiles_of(said), "profile_id")
    return persona.state_blocks(states.withColumn("reply_guidance", F.lit("")))


@query("latest_sessions", "SELECT user_id AS session_id, max(ts) AS updated_at, count(*) AS messages FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def latest_sessions(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("updated_at"), F.count("*").alias("messages")).orderBy(F.desc("updated_at"), "session_id").limit(20)


@query("injected_payload", "SELECT conv_id, CASE WHEN arg_min(role, turn) = 'system' THEN 'system,memory' || coalesce(',' || string_agg(role, ',' ORDER BY turn) FILTER (WHERE turn > lo), '') ELSE 'memory,' || string_agg(role, ',' ORDER BY turn) END AS roles FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS lo FROM conversations) GROUP BY conv_id")
def injected_payload(spark, d):
    """The roles of each conversation's messages with a memory message put behind a leading system message."""
    listed = turn_table(spark, d).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))
    memory = F.struct(F.lit("memory").alias("role"), messages.injected(F.lit(""), F.lit("core"), F.lit(""), F.lit(""), 1200).alias("content"))
    return listed.select("conv_id", F.array_join(F.transform(messages.insert_message(F.col("messages"), memory), lambda m: m["role"]), ",").alias("roles"))


@query("checked_answers", MEM + "SELECT id, CASE WHEN id % 3 = 0 THEN 0.5 ELSE least(1, valence * 2) END AS valence, CASE WHEN id % 3 = 0 THEN 0.3 ELSE arousal END AS arousal, CASE WHEN id % 3 = 0 THEN '' ELSE array_to_string(tags, ',') END AS tags, CASE WHEN id % 3 = 0 THEN '' ELSE name END AS name FROM mem")
def checked_answers(spark, d):
    body = F.to_json(F.struct((F.col("valence") * 2).alias("valence"), "arousal", "tags", F.col("name").alias("suggested_name")))
    raw = F.when(F.col("id") % 3 == 0, F.lit("sorry")).when(F.col("id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    a = memories(spark, d).select("id", answers.analysis(raw).alias("a"))
    return a.select("id", "a.valence", "a.arousal", F.array_join("a.tags", ",").alias("tags"), F.col("a.suggested_name").alias("name"))


@query("routed_models", "SELECT event_id AS request_id, CASE event_type WHEN 'view' THEN 'm1' WHEN 'click' THEN 'm2' ELSE 'm9' END AS model, CASE event_type WHEN 'view' THEN 'first' WHEN 'click' THEN 'first' ELSE NULL END AS upstream FROM events")
def routed_models(spark, d):
    upstreams = spark.createDataFrame([(0, "first", ["m1", "m2"]), (1, "second", ["m2", "m3"])], "place int, upstream string, models array<string>")
    model = F.when(F.col("event_type") == "view", " m1").when(F.col("event_type") == "click", "m2 ").otherwise("m9")
    return tools.routed(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), model.alias("model")), upstreams)


@query("markdown_files", MEM + r"SELECT id::VARCHAR AS id, store || '/' || lang || '/doc ' || id || '_' || id || '.md' AS path, name FROM (SELECT *, domain[1] AS lang FROM mem)")
def markdown_files(spark, d):
    files = markdown.as_markdown(memories(spark, d))
    return markdown.front_fields(files).select("id", "path", "name")


@query("traced_snapshot", MEM + f"SELECT id, CASE WHEN id % 4 = 0 AND (id % 15) BETWEEN 1 AND 10 AND NOT (pinned OR protected) THEN id % 15 ELSE importance END::INT AS importance, CASE WHEN id % 4 = 0 AND id % 5 < 2 THEN id % 5 = 1 ELSE digested END AS digested, CASE WHEN id % 4 = 0 THEN {sql.NOW} ELSE last_active END AS last_active FROM mem WHERE id % 12 <> 8")
def traced_snapshot(spark, d):
    m, k = memories(spark, d), F.col("id")
    none = F.lit(-1)
    patches = m.where((k % 4 == 0) | (k % 12 == 8)).select("id", none.cast("double").alias("valence"), F.lit(2.0).alias("arousal"), (k % 15).cast("int").alias("importance"), none.alias("resolved"), none.alias("pinned"), (k % 5).cast("int").alias("digested"), F.when(k % 12 == 8, 1).otherwise(0).alias("delete"))
    return tools.trace(m, patches, now_column()).select("id", "importance", "digested", "last_active")


@query("keyword_lists", MEM + "SELECT id, array_to_string([w.w FOR w IN list_sort([{'n': -length(x), 'w': x} FOR x IN list_distinct(['tag', lang_name, name, 'x'] || tags) IF length(x) >= 2 AND lower(x) <> 'tag'])], ',') AS words FROM (SELECT *, domain[1] || ' text' AS lang_name FROM mem)")
def keyword_lists(spark, d):
    words = F.concat(F.array(F.lit(" tag "), F.concat(F.get("domain", F.lit(0)), F.lit(" text")), F.col("name"), F.lit("x")), F.col("tags"))
    return memories(spark, d).select("id", F.array_join(tools.normal_keywords(words, ["tag"]), ",").alias("words"))


@query("held_texts")
def held_texts(spark, d):
    """What becomes of five new texts: merged into a memory or created."""
    said = [(0, "the tion of ing", "en"), (1, "eau la que", "fr"), (2, "doc 7", "es"), (3, "sch ung", "de"), (4, "keep this", "en")]
    news = spark.createDataFrame(said, "n long, content string, lang string").select(
        (F.lit(10_000_000) + F.col("n")).alias("new_id"), "content", F.array("lang").alias("domain"), F.array(F.lit("new")).alias("tags"), F.lit(0.6).alias("valence"), F.lit(0.4).alias("arousal"),
        F.lit(5).alias("importance"), (F.col("n") == 4).alias("pinned"), F.lit("dynamic").alias("type"),
    )
    return tools.hold(memories(spark, d), news, now_column())[1]


@query("digested_sources", MEM + f"SELECT id, digested OR id % 9 = 0 AS digested, CASE WHEN id % 9 = 0 AND id % 13 <= 10 THEN (id % 13)::DOUBLE / 10 END AS model_valence, CASE WHEN id % 9 = 0 THEN {sql.NOW} ELSE last_active END AS last_active FROM mem")
def digested_sources(spark, d):
    """Memories that feelings were written about: digested, with the feeling's valence unless it is out of range."""
    m, k = memories(spark, d), F.col("id")
    feelings = m.where(k % 9 == 0).select(k.alias("source"), (k + 10_000_000).alias("new_id"), (k % 13 / F.lit(10.0)).alias("valence"))
    return writes.digested(m, feelings, now_column()).select("id", "digested", "model_valence", "last_active")


@query("import_status", """WITH c AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chunk FROM documents),
d AS (SELECT *, doc_id % 10 AS k, CASE WHEN doc_id % 37 = 0 THEN 'Chunk ' || chunk || ': no answer for ' || doc_id END AS failed FROM c WHERE source <> 'src1' OR doc_id % 5 <> 0)
SELECT c.source AS source_hash, count(*) AS total_chunks, count(d.doc_id) AS processed, count(d.doc_id) AS api_calls, coalesce(sum(d.k) FILTER (WHERE d.failed IS NULL), 0)::BIGINT AS memories_created, coalesce(sum(d.k // 4) FILTER (WHERE d.failed IS NULL), 0)::BIGINT AS memories_merged, coalesce(sum(d.k // 5) FILTER (WHERE d.failed IS NULL), 0)::BIGINT AS memories_raw,
array_to_string(list_slice(coalesce(list(d.failed ORDER BY c.chunk) FILTER (WHERE d.failed IS NOT NULL), []), 1, 100), '|') AS errors, CASE WHEN count(d.doc_id) = count(*) THEN 'completed' WHEN c.source = 'src1' THEN 'paused' ELSE 'running' END AS status FROM c LEFT JOIN d USING (source, doc_id) GROUP BY c.source""")
def import_status(spark, d):
    """Documents as chunks of an import a source; one source is paused with a fifth of its chunks still to do."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = F.col("doc_id")
    planned = docs.select(F.col("source").alias("source_hash"), n.cast("string").alias("chunk_id"), (F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1).alias("chunk"))
    ok = lambda c: F.when(n % 37 != 0, c.cast("long")).otherwise(0)
    outcomes = docs.where((F.col("source") != "src1") | (n % 5 != 0)).select(
        n.cast("string").alias("chunk_id"), F.lit(1).alias("api_calls"), ok(n % 10).alias("created"), ok(F.floor(n % 10 / 4)).alias("merged"), ok(F.floor(n % 10 / 5)).alias("raw"),
        F.when(n % 37 == 0, F.concat(F.lit("no answer for "), n.cast("string"))).alias("error"),
    )
    paused = spark.createDataFrame([("src1",)], "source_hash string")
    status = imports.import_status(planned, outcomes, paused)
    return status.withColumn("errors", F.array_join("errors", "|"))


@query("masked_keys", MEM + "SELECT id, CASE WHEN length(k) > 8 THEN left(k, 4) || '...' || right(k, 4) WHEN k <> '' THEN '***' ELSE '' END AS shown FROM (SELECT id, left(content, (id % 14)::INT) AS k FROM mem)")
def masked_keys(spark, d):
    return memories(spark, d).select("id", text.masked(F.left("content", (F.col("id") % 14).cast("int"))).alias("shown"))
