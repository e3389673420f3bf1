"""All registered queries of the engine: a plan and, where SQL can express it, the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions import scoring, text
from tidepool.operators import change_log, fuzzy_search, packing, pairs, pivots, predicates, ranking, turns, writes
from tidepool.plans import memory_plans as plans
from tidepool.plans import sql
from tidepool.sources import providers
from tidepool.sources.memory import memories, now_column, rounds, vectors as vector_table
from tidepool.sources.memory import turns as turn_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Test vectors are hardly alike; queries over them use this floor for the usual 0.5 and 0.7.
FLOOR = 0.3
WORDS = ["the", "tion", "ing", "de"]
#: Characters of a content that a summary takes, and that a fuzzy search does.
SUMMARY, FUZZY = 200, 1000


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + "\n"


MEM = with_(sql.MEM)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return plans.with_score(memories(spark, d))


# --- scores and scalar functions


@query(
    "surface",
    MEM + f""", core AS (SELECT coalesce(sum({sql.tokens(sql.summary())}), 0) AS core_tokens FROM mem WHERE store <> 'archive' AND (pinned OR protected)),
best AS (SELECT id, score, {sql.tokens(sql.summary())} AS tokens FROM scored WHERE store <> 'archive' AND {sql.CAN_SURFACE} ORDER BY score DESC, id LIMIT 20),
run AS (SELECT *, sum(tokens) OVER (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM best)
SELECT id, score, tokens::INT AS tokens, used::BIGINT AS used FROM run, core WHERE used <= 10000 - core_tokens AND used - tokens < 10000 - core_tokens""",
)
def surface(spark, d):
    return plans.surface(memories(spark, d))


@query("decay_score", MEM + "SELECT id, type, score FROM scored")
def decay_score(spark, d):
    return scored(spark, d).select("id", "type", "score")


@query("freshness", MEM + "SELECT id, round(1 + exp(-days * 24 / 36), 4) AS fresh, round(exp(-0.1::DOUBLE * days), 4) AS near, importance::DOUBLE / 10 AS weight FROM mem")
def freshness(spark, d):
    return memories(spark, d).select("id", F.round(scoring.freshness(F.col("days")), 4).alias("fresh"), F.round(scoring.time_proximity(F.col("days")), 4).alias("near"), scoring.importance_share(F.col("importance")).alias("weight"))


@query("emotion_match", MEM + "SELECT id, round(greatest(0, 1 - sqrt(pow(0.6::DOUBLE - valence, 2) + pow(0.4::DOUBLE - arousal, 2)) / 1.414::DOUBLE), 4) AS match, 0.5::DOUBLE AS unasked FROM mem")
def emotion_match(spark, d):
    c = F.col
    none = F.lit(None).cast("double")
    return memories(spark, d).select("id", F.round(scoring.emotion_match(F.lit(0.6), F.lit(0.4), c("valence"), c("arousal")), 4).alias("match"), scoring.emotion_match(none, F.lit(0.4), c("valence"), c("arousal")).alias("unasked"))


@query("mood_shift", MEM + "SELECT id, round(greatest(0, least(1, valence + (0.9::DOUBLE - 0.5) * 0.2)), 4) AS shifted, valence AS plain FROM mem")
def mood_shift(spark, d):
    return memories(spark, d).select("id", F.round(scoring.mood_shift(F.col("valence"), F.lit(0.9)), 4).alias("shifted"), scoring.mood_shift(F.col("valence"), F.lit(None).cast("double")).alias("plain"))


@query("token_estimate", MEM + f"SELECT id, {sql.tokens('content')} AS tokens, sha256(content) AS content_hash, {sql.links_off(chr(39) + 'see [[' + chr(39) + ' || name || ' + chr(39) + ']] and [[x]]' + chr(39))} AS plain FROM mem")
def token_estimate(spark, d):
    linked = F.concat(F.lit("see [["), "name", F.lit("]] and [[x]]"))
    return memories(spark, d).select("id", text.token_estimate(F.col("content")).alias("tokens"), text.content_hash(F.col("content")).alias("content_hash"), text.without_links(linked).alias("plain"))


@query("safe_name", MEM + r"SELECT id, left(regexp_replace(trim(regexp_replace(content, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s-]', '', 'g')), '^\s+|\s+$', '', 'g'), 80) AS name FROM mem")
def safe_name(spark, d):
    return memories(spark, d).select("id", text.safe_name(F.col("content")).alias("name"))


@query("thinking_mode", MEM + "SELECT id, CASE id % 4 WHEN 0 THEN 'enabled' WHEN 1 THEN 'disabled' WHEN 2 THEN '' ELSE 'disabled' END AS mode FROM mem")
def thinking_mode(spark, d):
    given = F.element_at(F.array(F.lit(" On "), F.lit("non_thinking"), F.lit("maybe"), F.lit("FALSE")), (F.col("id") % 4 + 1).cast("int"))
    return memories(spark, d).select("id", text.thinking_mode(given).alias("mode"))


# --- predicates and projections


@query(
    "predicates",
    MEM + f"""SELECT id, {sql.CAN_SURFACE} AS can_surface, pinned OR protected AS is_core, {sql.CAN_DREAM} AS can_dream, {sql.CAN_RECALL} AS can_recall,
  type <> 'feel' AND NOT pinned AND NOT protected AND created >= {sql.NOW} - to_hours(72) AS is_recent, type = 'dynamic' AND NOT pinned AND NOT resolved AS in_patterns,
  {sql.CAN_DREAM} AND NOT resolved AND importance <= 4 AND days > 30 AS resolves_itself, score < 0.3 AS fades, valence BETWEEN 0.2 AND 0.8 AS mild FROM scored""",
)
def predicate_flags(spark, d):
    p, now = predicates, now_column()
    return scored(spark, d).select(
        "id", p.can_surface().alias("can_surface"), p.is_core().alias("is_core"), p.can_dream().alias("can_dream"), p.can_be_recalled().alias("can_recall"), p.is_recent(now, 72).alias("is_recent"), p.in_patterns().alias("in_patterns"),
        (p.decays() & p.resolves_itself(F.col("days"))).alias("resolves_itself"), p.fades(F.col("score")).alias("fades"), F.col("valence").between(0.2, 0.8).alias("mild"),
    )


@query("domain_filter", MEM + "SELECT id, score FROM scored WHERE lower(domain[1]) IN ('en', 'zz')")
def domain_filter(spark, d):
    return predicates.in_domains(scored(spark, d), ["EN", "zz"]).select("id", "score")


@query("domain_filter_fallback", MEM + "SELECT id, score FROM scored")
def domain_filter_fallback(spark, d):
    return predicates.in_domains(scored(spark, d), ["zz"]).select("id", "score")


@query("broken_rows", MEM + "SELECT id, id % 5 = 0 OR id % 7 = 0 AS broken FROM mem")
def broken_rows(spark, d):
    m = memories(spark, d).withColumn("name", F.when(F.col("id") % 5 == 0, "").otherwise(F.col("name"))).withColumn("domain", F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("domain")))
    return m.select("id", predicates.is_broken().alias("broken"))


@query("valid_mood", MEM + "SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE valence END AS asked FROM mem")
def valid_mood(spark, d):
    given = F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("valence"))
    return memories(spark, d).select("id", predicates.valid_mood(given).alias("asked"))


@query("summaries", MEM + f"SELECT id, {sql.summary()} AS summary, CASE WHEN pinned OR protected THEN '📌' WHEN type = 'permanent' THEN '📦' WHEN type = 'feel' THEN '🫧' WHEN type = 'archived' THEN '🗄️' WHEN resolved THEN '✅' ELSE '💭' END AS icon FROM mem")
def summaries(spark, d):
    c = F.col
    return memories(spark, d).select("id", plans.summary(c("content")).alias("summary"), text.status_icon(c("type"), c("resolved"), c("pinned"), c("protected")).alias("icon"))


@query(
    "pulse",
    MEM + """SELECT id, CASE WHEN pinned OR protected THEN '📌' WHEN type = 'permanent' THEN '📦' WHEN type = 'feel' THEN '🫧' WHEN type = 'archived' THEN '🗄️' WHEN resolved THEN '✅' ELSE '💭' END
  || ' [' || name || ']' || CASE WHEN resolved THEN ' [已解决]' ELSE '' END || ' bucket_id:' || id || ' 主题:' || array_to_string(domain, ',') || ' 情感:V' || printf('%.1f', round(valence, 1)) || '/A' || printf('%.1f', round(arousal, 1))
  || ' 重要:' || importance || ' 权重:' || printf('%.2f', round(score::DECIMAL(18, 4), 2)) || ' 标签:' || array_to_string(tags, ',') AS line FROM scored""",
)
def pulse(spark, d):
    return plans.pulse(memories(spark, d))


@query("dashboard", MEM + f"SELECT id, name, type, domain[1] AS domain, array_to_string(tags, ',') AS tags, valence, arousal, importance, activation_count, resolved, pinned, digested, created, last_active, score, left({sql.links_off('content')}, 200) AS preview FROM scored")
def dashboard(spark, d):
    return scored(spark, d).select("id", "name", "type", F.get("domain", F.lit(0)).alias("domain"), F.array_join("tags", ",").alias("tags"), "valence", "arousal", "importance", "activation_count", "resolved", "pinned", "digested", "created", "last_active", "score", F.left(text.without_links(F.col("content")), F.lit(200)).alias("preview"))


@query("detail", MEM + f"SELECT id, {sql.links_off('content')} AS content, score FROM scored WHERE id = 42")
def detail(spark, d):
    return scored(spark, d).where(F.col("id") == 42).select("id", text.without_links(F.col("content")).alias("content"), "score")


@query("import_results", MEM + "SELECT id, left(content, 300) AS preview, count(*) OVER () AS total FROM (SELECT * FROM mem ORDER BY created DESC, id LIMIT 50)")
def import_results(spark, d):
    latest = memories(spark, d).orderBy(F.desc("created"), "id").limit(50)
    return latest.select("id", F.left("content", F.lit(300)).alias("preview"), F.count("*").over(Window.partitionBy()).alias("total"))


TOPIC_SQL = "(" + " + ".join(f"contains(lower(content), '{w}')::INT" for w in WORDS) + f")::DOUBLE / {len(WORDS)}"
RELEVANT = f""", rel0 AS (SELECT *, {TOPIC_SQL} AS topic, greatest(0, 1 - sqrt(pow(0.6::DOUBLE - valence, 2) + pow(0.4::DOUBLE - arousal, 2)) / 1.414::DOUBLE) AS emotion, exp(-0.1::DOUBLE * days) AS time, importance::DOUBLE / 10 AS weight FROM scored),
rel AS (SELECT *, topic * 4 + emotion * 2 + time * 2.5::DOUBLE + weight AS raw, (topic * 4 + emotion * 2 + time * 2.5::DOUBLE + weight) / 9.5::DOUBLE * 100 * CASE WHEN resolved THEN 0.3::DOUBLE ELSE 1 END AS relevance FROM rel0)
"""


@query("score_breakdown", MEM + RELEVANT + "SELECT id, round(topic, 4) AS topic, round(emotion, 4) AS emotion, round(time, 4) AS time, round(weight, 4) AS weight, round(raw, 4) AS raw_total, round(relevance, 2) AS normalized, relevance >= 50 AS passed FROM rel")
def score_breakdown(spark, d):
    return plans.breakdown(memories(spark, d), plans.word_topic(WORDS), 0.6, 0.4)


@query("keyword_search", MEM + RELEVANT + "SELECT id, round(relevance, 2) AS score FROM rel WHERE store <> 'archive' AND relevance >= 50 ORDER BY score DESC, id LIMIT 10")
def keyword_search(spark, d):
    return plans.keyword_hits(memories(spark, d), plans.word_topic(WORDS), 10, 0.6, 0.4).select("id", "score")


@query("search_list", MEM + RELEVANT + f"SELECT id, name, round(relevance, 2) AS score, array_to_string(domain, ',') AS domain, valence, arousal, left({sql.links_off('content')}, 200) AS content_preview FROM rel WHERE store <> 'archive' AND relevance >= 50 ORDER BY score DESC, id LIMIT 10")
def search_list(spark, d):
    """The hits with what a list shows of each."""
    hits = plans.keyword_hits(memories(spark, d), plans.word_topic(WORDS), 10, 0.6, 0.4)
    return hits.select("id", "name", "score", F.array_join("domain", ",").alias("domain"), "valence", "arousal", F.left(text.without_links(F.col("content")), F.lit(200)).alias("content_preview"))


# --- aggregates


@query("store_stats", MEM + "SELECT store, count(*) AS n, round(sum(strlen(content))::DOUBLE / 1024, 2) AS kb FROM mem GROUP BY store")
def store_stats(spark, d):
    return memories(spark, d).groupBy("store").agg(F.count("*").alias("n"), F.round(F.sum(F.octet_length("content")) / F.lit(1024.0), 2).alias("kb"))


@query("store_domains", MEM + "SELECT store, domain[1] AS domain, count(*) AS n FROM mem GROUP BY ALL")
def store_domains(spark, d):
    return memories(spark, d).groupBy("store", F.get("domain", F.lit(0)).alias("domain")).agg(F.count("*").alias("n"))


@query("tag_histogram", MEM + "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM mem) GROUP BY tag")
def tag_histogram(spark, d):
    return memories(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("search_totals", MEM + RELEVANT + "SELECT count(*) FILTER (WHERE relevance >= 50) AS passed_count, count(*) AS total_candidates FROM rel")
def search_totals(spark, d):
    return plans.breakdown(memories(spark, d), plans.word_topic(WORDS), 0.6, 0.4).agg(F.count_if("passed").alias("passed_count"), F.count("*").alias("total_candidates"))


@query("core_counts", MEM + f"SELECT count(*) FILTER (WHERE pinned OR protected) AS core, count(*) FILTER (WHERE {sql.CAN_SURFACE}) AS unresolved FROM mem")
def core_counts(spark, d):
    return memories(spark, d).agg(F.count_if(predicates.is_core()).alias("core"), F.count_if(predicates.can_surface()).alias("unresolved"))


KEYWORDS = {"prose": ["the", "tion", "ing"], "romance": ["eau", "la ", "que"], "german": ["sch", "der", "ung"]}
_HITS = "SELECT id, domain, hits, row_number() OVER (PARTITION BY id ORDER BY hits DESC, pos) AS nth FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS domain, {i} AS pos, " + " + ".join(f"contains(lower(content), '{w}')::INT" for w in ws) + " AS hits FROM mem" for i, (k, ws) in enumerate(KEYWORDS.items())) + ") WHERE hits >= 2"


@query("keyword_domains", MEM + f", h AS ({_HITS}) SELECT m.id, coalesce(string_agg(h.domain, ',' ORDER BY h.nth), array_to_string(any_value(m.domain), ',')) AS domains FROM mem m LEFT JOIN h ON h.id = m.id AND h.nth <= 2 GROUP BY m.id")
def keyword_domains(spark, d):
    """The two domains with the most keywords in a text, from two keywords on; the old ones where none has."""
    low = F.lower("content")
    hits = F.array(*[F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("hits"), F.lit(-i).alias("pos"), F.lit(k).alias("domain")) for i, (k, ws) in enumerate(KEYWORDS.items())])
    best = F.slice(F.sort_array(F.filter(hits, lambda h: h["hits"] >= 2), asc=False), 1, 2)
    return memories(spark, d).select("id", F.when(F.size(best) > 0, F.array_join(F.transform(best, lambda h: h["domain"]), ",")).otherwise(F.array_join("domain", ",")).alias("domains"))


# --- sessions

ROUNDS = with_(sql.ROUNDS)


@query("round_counts", ROUNDS + "SELECT session_id, coalesce(max(round_id), 0) AS last_round, count(DISTINCT bucket_id) AS buckets FROM rounds GROUP BY session_id")
def round_counts(spark, d):
    return rounds(spark, d).groupBy("session_id").agg(F.coalesce(F.max("round_id"), F.lit(0)).alias("last_round"), F.count_distinct("bucket_id").alias("buckets"))


@query("recent_buckets", ROUNDS + "SELECT session_id, bucket_id FROM recents")
def recent_buckets(spark, d):
    return ranking.recent_rounds(rounds(spark, d), 5)


@query("last_injections", ROUNDS + f"SELECT session_id, bucket_id, injected_at, {sql.cooled(f'(epoch_us({sql.NOW}) - epoch_us(injected_at))::DOUBLE / 3600000000')} AS multiplier FROM lasts")
def last_injections(spark, d):
    last = ranking.last_injections(rounds(spark, d))
    hours = F.timestamp_diff("MICROSECOND", F.col("injected_at"), now_column()) / F.lit(3_600e6)
    return last.withColumn("multiplier", scoring.cooldown(hours))


@query("injection_before", ROUNDS + "SELECT session_id, round_id, bucket_id, max(completed_at) OVER (PARTITION BY session_id, bucket_id ORDER BY round_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS injected_before FROM rounds")
def injection_before(spark, d):
    """The as-of form: when a bucket was last injected before each of its rounds."""
    w = Window.partitionBy("session_id", "bucket_id").orderBy("round_id").rowsBetween(Window.unboundedPreceding, -1)
    return rounds(spark, d).select("session_id", "round_id", "bucket_id", F.max("completed_at").over(w).alias("injected_before"))


_SPLIT = "list_distinct(list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"
RECALL = (
    with_(sql.MEM, sql.ROUNDS, sql.VECTORS)
    + f""", asked AS (SELECT session_id, {_SPLIT.format("query")} AS asked FROM (SELECT conv_id AS session_id, arg_max(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS query FROM conversations GROUP BY conv_id) WHERE query IS NOT NULL AND session_id IN (SELECT session_id FROM rounds)),
held AS (SELECT id, {_SPLIT.format("content")} AS words FROM mem WHERE {sql.CAN_RECALL}),
kw AS (SELECT session_id, id, shared::DOUBLE / len(asked) AS score FROM (SELECT *, len(list_intersect(asked, words)) AS shared FROM asked, held) WHERE shared > 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, id) <= 10),
se AS (SELECT session_id, id, greatest(0, least(1, similarity)) AS score FROM (SELECT session_id, v.id, round({sql.cosine("v.embedding", "q.embedding")}, 6) AS similarity FROM asked JOIN vectors q ON q.id = session_id, vectors v) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY similarity DESC, id) <= 10),
met AS (SELECT coalesce(k.session_id, s.session_id) AS session_id, coalesce(k.id, s.id) AS id, coalesce(k.score, 0) AS k, coalesce(s.score, 0) AS s FROM kw k FULL JOIN se s ON k.session_id = s.session_id AND k.id = s.id),
sc AS (SELECT met.session_id, met.id, round((s * 0.45::DOUBLE + k * 0.35::DOUBLE + importance::DOUBLE / 10 * 0.1::DOUBLE + exp(-0.1::DOUBLE * days) * 0.1::DOUBLE) * {sql.cooled(f"(epoch_us({sql.NOW}) // 1000000 - epoch_us(injected_at) // 1000000)::DOUBLE / 3600")}, 4) AS score
  FROM met JOIN mem USING (id) LEFT JOIN lasts l ON l.session_id = met.session_id AND l.bucket_id = met.id WHERE {sql.CAN_RECALL}),
mk AS (SELECT sc.*, r.bucket_id IS NULL AS fresh FROM sc LEFT JOIN recents r ON r.session_id = sc.session_id AND r.bucket_id = sc.id),
kept AS (SELECT * FROM (SELECT *, bool_or(fresh) OVER (PARTITION BY session_id) AS any_fresh FROM mk) WHERE fresh OR NOT any_fresh),
rk AS (SELECT session_id, id, score, row_number() OVER w AS rank, first_value(score) OVER w AS best FROM kept WINDOW w AS (PARTITION BY session_id ORDER BY score DESC, id))
SELECT session_id, id, score, rank FROM rk WHERE (rank = 1 AND score >= 0.55) OR (rank = 2 AND best >= 0.55 AND score >= 0.5 AND score >= best * 0.85::DOUBLE)"""
)


def _searches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What both searches answer each session, over all memories: (session_id, id, score) by words, and by vectors.

    A session asks the last user message of the conversation of its number; as no model is at hand, the vector of
    that number stands for the message's. Sessions without a message recall nothing.
    """
    asked = turns.last_messages(turn_table(spark, d)).where("query IS NOT NULL").select(F.col("conv_id").alias("session_id"), "query")
    asked = asked.join(rounds(spark, d).select("session_id").distinct(), "session_id", "left_semi")
    v = vector_table(spark, d)
    queries = v.join(asked.select(F.col("session_id").alias("id")), "id", "left_semi").select(F.col("id").alias("asked_id"), F.col("embedding").alias("asked"))
    near = pairs.nearest_each(v, queries, 10).select(F.col("asked_id").alias("session_id"), "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "similarity")).alias("score"))
    return plans.word_hits(memories(spark, d), asked, 10), near


@query("recall_searched", RECALL)
@query("recall_cards", RECALL)
def recall_cards(spark, d):
    """One or two cards a session from both searches over all memories; the older name is kept beside the newer."""
    return plans.recall(memories(spark, d), *_searches(spark, d), rounds(spark, d), now_column())


@query("hybrid_candidates", RECALL.split("SELECT session_id, id, score, rank FROM rk")[0] + "SELECT session_id, id, k, s FROM met")
def hybrid_candidates(spark, d):
    keyword, semantic = _searches(spark, d)
    met = keyword.withColumnRenamed("score", "k").join(semantic.withColumnRenamed("score", "s"), ["session_id", "id"], "full_outer")
    return met.select("session_id", "id", F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("s", F.lit(0.0)).alias("s"))


# --- vectors

VECTORS = with_(sql.MEM, sql.VECTORS)
PAIRS = f", edges AS (SELECT a.id AS source, b.id AS target, {sql.cosine('a.embedding', 'b.embedding')} AS similarity FROM vectors a JOIN vectors b ON a.id < b.id)"


@query("nearest_vectors", VECTORS + f"SELECT asked_id, id, similarity FROM (SELECT q.id AS asked_id, v.id, round({sql.cosine('v.embedding', 'q.embedding')}, 6) AS similarity FROM vectors v, (SELECT id, embedding FROM vectors WHERE id % 50 = 0) q) QUALIFY row_number() OVER (PARTITION BY asked_id ORDER BY similarity DESC, id) <= 10")
def nearest_vectors(spark, d):
    """The ten vectors nearest to each whose id is divisible by 50, through pivots."""
    v = vector_table(spark, d)
    return pivots.nearest_by_pivots(v, v.where("id % 50 = 0").select(F.col("id").alias("asked_id"), F.col("embedding").alias("asked")), 10)


@query("similarity_network", VECTORS + PAIRS + f" SELECT source, target, round(similarity, 3) AS similarity FROM edges WHERE similarity > {FLOOR}")
def similarity_network(spark, d):
    return pairs.similar_pairs(vector_table(spark, d), FLOOR).select("source", "target", F.round("similarity", 3).alias("similarity"))


@query("dream_pair", VECTORS + PAIRS + ", few AS (SELECT id FROM mem WHERE store <> 'archive' AND " + sql.CAN_DREAM + f" ORDER BY created DESC, id LIMIT 40) SELECT source, target, round(similarity, 4) AS similarity FROM edges WHERE source IN (FROM few) AND target IN (FROM few) AND similarity > 0.1 ORDER BY 3 DESC, 1, 2 LIMIT 1")
def dream_pair(spark, d):
    return plans.best_pair(vector_table(spark, d).join(plans.dream(memories(spark, d), 40).select("id"), "id", "left_semi"), 0.1)


@query("crowded_feelings", VECTORS + PAIRS + ", f AS (SELECT id FROM mem WHERE type = 'feel'), e AS (SELECT * FROM edges WHERE similarity > 0.15 AND source IN (FROM f) AND target IN (FROM f)) SELECT id, count(*) AS similar FROM (SELECT source AS id FROM e UNION ALL SELECT target FROM e) GROUP BY id HAVING count(*) >= 2")
def crowded_feelings(spark, d):
    """Feelings with at least two similar others; the first in scan order that isn't pinned is the one to hint at."""
    feel = vector_table(spark, d).join(memories(spark, d).where("type = 'feel'").select("id"), "id", "left_semi")
    return pairs.crowded(pairs.similar_pairs(feel, 0.15), 2)


@query("missing_vectors", VECTORS + "SELECT id, name FROM mem WHERE id NOT IN (SELECT id FROM vectors)")
def missing_vectors(spark, d):
    return memories(spark, d).select("id", "name").join(vector_table(spark, d).select("id"), "id", "left_anti")


@query("vector_get", VECTORS + "SELECT id, len(embedding) AS size, round(list_dot_product(embedding, embedding), 6) AS square FROM vectors WHERE id IN (SELECT id FROM mem WHERE type = 'feel')")
def vector_get(spark, d):
    """The stored vectors of all feelings."""
    got = writes.found(vector_table(spark, d), memories(spark, d).where("type = 'feel'"))
    return got.select("id", F.size("embedding").cast("long").alias("size"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


@query("vector_delete", VECTORS + "SELECT id FROM vectors WHERE id NOT IN (SELECT id FROM mem WHERE store = 'archive')")
def vector_delete(spark, d):
    """The ids whose vectors are left once those of archived memories are deleted."""
    return writes.deleted(vector_table(spark, d), memories(spark, d).where("store = 'archive'")).select("id")


@query("backfill_counts", VECTORS + "SELECT count(*) FILTER (WHERE NOT blank) AS success, 0::BIGINT AS failed, count(*) FILTER (WHERE blank) AS skipped FROM (SELECT regexp_full_match(coalesce(content, ''), '\\s*') AS blank FROM mem WHERE id NOT IN (SELECT id FROM vectors))")
def backfill_counts(spark, d):
    """What became of the memories without a vector, by a model that never fails."""
    return providers.backfill_counts(providers.backfilled(memories(spark, d), vector_table(spark, d), providers.HashedVectors))


@query("vector_only_hits", VECTORS + RELEVANT + f", kw AS (SELECT id FROM rel WHERE store <> 'archive' AND relevance >= 50 ORDER BY round(relevance, 2) DESC, id LIMIT 20), nn AS (SELECT q.id AS asked_id, v.id, round({sql.cosine('v.embedding', 'q.embedding')}, 6) AS similarity FROM vectors v, (SELECT id, embedding FROM vectors WHERE id % 50 = 0) q QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round({sql.cosine('v.embedding', 'q.embedding')}, 6) DESC, v.id) <= 20) SELECT nn.asked_id, nn.id, round(similarity * 100, 2) AS score, m.type FROM nn JOIN mem m USING (id) WHERE similarity > 0.1 AND id NOT IN (FROM kw)")
def vector_only_hits(spark, d):
    """What the vectors of all ids divisible by 50 find that one search by words doesn't."""
    m, v = memories(spark, d), vector_table(spark, d)
    words = plans.keyword_hits(m, plans.word_topic(WORDS), 20, 0.6, 0.4).select("id")
    near = pivots.nearest_by_pivots(v, v.where("id % 50 = 0").select(F.col("id").alias("asked_id"), F.col("embedding").alias("asked")), 20).where("similarity > 0.1")
    return near.join(words, "id", "left_anti").join(m.select("id", "type"), "id").select("asked_id", "id", F.round(F.col("similarity") * 100, 2).alias("score"), "type")


@query("drift_pool", MEM + RELEVANT + f", hit AS (SELECT id FROM rel WHERE store <> 'archive' AND relevance >= 50 ORDER BY round(relevance, 2) DESC, id LIMIT 20) SELECT id, score FROM scored WHERE store <> 'archive' AND score < 2 AND id NOT IN (FROM hit) ORDER BY (id * 7919 + 5) % 10007, id LIMIT 3")
def drift_pool(spark, d):
    """Three faint memories that the search didn't meet, chosen by a seeded hash order."""
    m = memories(spark, d)
    words = plans.keyword_hits(m, plans.word_topic(WORDS), 20, 0.6, 0.4).select("id")
    faint = plans.with_score(m).where("store <> 'archive' AND score < 2").join(words, "id", "left_anti")
    return faint.select("id", "score").orderBy((F.col("id") * 7919 + 5) % 10007, "id").limit(3)


CLUSTERED = 0.25


PATTERNS = (VECTORS + PAIRS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT id, name, content FROM mem WHERE type = 'dynamic' AND NOT pinned AND NOT resolved),
e AS (SELECT source, list(target) AS near FROM edges WHERE similarity > {CLUSTERED} AND source IN (SELECT id FROM p) AND target IN (SELECT id FROM p) GROUP BY source),
nodes AS (SELECT v.id, row_number() OVER (ORDER BY v.id) AS n, coalesce(near, []::BIGINT[]) AS near FROM vectors v JOIN p USING (id) LEFT JOIN e ON e.source = v.id),
r AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS claimed, NULL::BIGINT AS lead, []::BIGINT[] AS own
  UNION ALL SELECT nodes.n, CASE WHEN list_contains(claimed, id) THEN claimed ELSE claimed || [id] || list_filter(near, lambda x: NOT list_contains(claimed, x)) END,
    CASE WHEN list_contains(claimed, id) THEN NULL ELSE id END, list_filter(near, lambda x: NOT list_contains(claimed, x)) FROM r JOIN nodes ON nodes.n = r.n + 1)
SELECT lead, (1 + len(own))::BIGINT AS n, CASE WHEN len(own) >= 4 THEN 'pin' ELSE 'review' END AS action, name, left(content, 200) AS preview, array_to_string(list_sort([lead] || own), ',') AS ids
FROM r JOIN p ON p.id = r.lead WHERE len(own) >= 2 ORDER BY n DESC, lead LIMIT 20"""


@query("pattern_clusters", PATTERNS)
def pattern_clusters(spark, d):
    """Greedy clusters of at least three similar memories with what is shown of their leads; five and more are worth a pin."""
    m = memories(spark, d, head=SUMMARY).where(predicates.in_patterns()).select("id", "name", "content")
    v = vector_table(spark, d).join(m.select("id"), "id", "left_semi")
    clusters = pairs.vector_clusters(v, CLUSTERED)
    sized = clusters.groupBy(F.col("leader").alias("lead")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids")).where("n >= 3")
    best = sized.withColumn("action", F.when(F.col("n") >= 5, "pin").otherwise("review")).orderBy(F.desc("n"), "lead").limit(20)
    return best.join(m, best.lead == m.id).select("lead", "n", "action", "name", F.left("content", F.lit(200)).alias("preview"), "ids")


# --- intervals, orders, packing


@query("ripple", MEM + f", p AS (SELECT a.id AS source, b.id AS target, row_number() OVER (PARTITION BY a.id ORDER BY b.seq) AS nth, abs(epoch(a.created) - epoch(b.created)) / 3600 AS gap_hours FROM mem a JOIN mem b ON a.id <> b.id AND abs(epoch(a.created) - epoch(b.created)) <= 48 * 3600 WHERE b.store <> 'archive' AND b.{sql.CAN_DREAM.replace('NOT pinned', 'NOT b.pinned').replace('NOT protected', 'NOT b.protected')}) SELECT source, target, nth, gap_hours FROM p WHERE nth <= 5")
def ripple(spark, d):
    m = memories(spark, d)
    return writes.ripple_targets(m, m.select("id"))


@query("core_order", MEM + "SELECT id, importance, last_active FROM mem WHERE pinned OR protected ")
def core_order(spark, d):
    return memories(spark, d).where(predicates.is_core()).select("id", "importance", "last_active").orderBy(F.desc("importance"), F.desc("last_active"), "id")


@query("recent_order", MEM + f"SELECT id, created FROM mem WHERE type <> 'feel' AND NOT pinned AND NOT protected AND created >= {sql.NOW} - to_hours(72) ORDER BY created DESC, id LIMIT 6")
def recent_order(spark, d):
    return ranking.top(memories(spark, d).where(predicates.is_recent(now_column(), 72)).select("id", "created"), 6, F.desc("created"), F.col("id"))


@query("dream", MEM + f"SELECT id, created, '[' || name || ']' || CASE WHEN resolved THEN ' [已解决]' ELSE ' [未解决]' END || ' 主题:' || array_to_string(domain, ',') || ' V' || printf('%.1f', round(valence, 1)) || '/A' || printf('%.1f', round(arousal, 1)) || chr(10) || 'ID: ' || id || chr(10) || {sql.links_off('left(content, 500)')} AS line FROM mem WHERE store <> 'archive' AND {sql.CAN_DREAM} ORDER BY created DESC, id LIMIT 10")
def dream(spark, d):
    return plans.dream(memories(spark, d))


@query("shuffled_order", MEM + f", b AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rk FROM scored WHERE {sql.CAN_SURFACE}) SELECT id, score, row_number() OVER (ORDER BY CASE WHEN rk = 1 THEN 0 WHEN rk <= 20 THEN 1 ELSE 2 END, CASE WHEN rk > 1 AND rk <= 20 THEN (id * 7919 + 3) % 10007 ELSE rk END, rk) AS place FROM b WHERE rk <= 50")
def shuffled_order(spark, d):
    """The order of a list of the most results that surfacing may show."""
    best = scored(spark, d).where(predicates.can_surface()).select("id", "score").orderBy(F.desc("score"), "id").limit(plans.MOST_RESULTS)
    ranked = best.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    return ranked.select("id", "score", F.row_number().over(Window.orderBy(*ranking.mixed(F.col("rk"), F.col("id"), 3))).alias("place"))


@query("feelings_pack", MEM + f", l AS (SELECT id, created, {sql.links_off('left(content, 200)')} AS line FROM mem WHERE type = 'feel' AND store <> 'archive' ), t AS (SELECT id, created, trunc(sum({sql.token_parts('line')}) OVER w + 0.05::DOUBLE * (row_number() OVER w - 1))::INT AS total FROM l WINDOW w AS (ORDER BY created DESC, id)) SELECT id, total FROM (SELECT *, lag(total, 1, 0) OVER (ORDER BY created DESC, id) AS before FROM t) WHERE before <= 400")
def feelings_pack(spark, d):
    return plans.feelings(memories(spark, d), 400)


@query("recalled_block")
def recalled_block(spark, d):
    """Cards of each session as one block, the first trimmed if it is too big."""
    best = recall_cards(spark, d).join(memories(spark, d, head=SUMMARY), "id")
    packed = packing.pack_trimmed(best.select("session_id", "id", "rank", plans.summary(F.col("content")).alias("summary")), 60, [F.col("rank")], ("session_id",))
    return packed.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "summary"))), lambda x: F.concat(F.lit("- "), x["summary"])), "\n").alias("block"), F.sum("tokens").alias("tokens"))


def breath_queries(spark: SparkSession, d: str) -> DataFrame:
    """The searches of the fuzzy queries: each memory whose id is divisible by 50 asks for its name and tags, in its own domain or anywhere, in some mood or none."""
    m, k = memories(spark, d).where("id % 50 = 0"), F.col("id")
    asked = m.select(k.alias("asked_id"), F.concat_ws(" ", "name", F.array_join("tags", " ")).alias("query"), F.when(k % 100 == 0, F.col("domain")).alias("domains"), F.when(k % 150 == 0, F.col("valence")).alias("valence"), F.when(k % 150 == 0, F.col("arousal")).alias("arousal"))
    return asked.join(vector_table(spark, d).select(k.alias("asked_id"), F.col("embedding").alias("asked")), "asked_id", "left")


@query("fuzzy_search")
def fuzzy_search_(spark, d):
    """The twenty best memories of each search by fuzzy relevance."""
    return fuzzy_search.fuzzy_hits(memories(spark, d, head=FUZZY), breath_queries(spark, d).drop("asked"), 20).select("asked_id", "id", "score", "rank")


@query("hybrid_search")
def hybrid_search(spark, d):
    """Whole searches: fuzzy hits, vector hits, what drifts up, within the budget."""
    told = plans.breath(memories(spark, d, head=FUZZY), vector_table(spark, d), breath_queries(spark, d), max_tokens=1000, floor=0.1)
    return told.withColumn("valence", F.round("valence", 6))


@query("merge_candidate")
def merge_candidate(spark, d):
    """The best match of each benchmark text, in a domain, in an unknown one or without: (item_id, id, score, verdict); pinned ones aren't merged into."""
    k = F.col("item_id")
    news = spark.read.parquet(f"{d}/benchmark.parquet").select(k.alias("asked_id"), F.col("text").alias("query"), F.when(k % 3 == 0, F.array(F.lit("EN"))).when(k % 3 == 1, F.array(F.lit("nowhere"))).alias("domains"), F.lit(None).cast("double").alias("valence"), F.lit(None).cast("double").alias("arousal"))
    m = memories(spark, d)
    best = fuzzy_search.fuzzy_hits(m, news, 1).join(m.select("id", predicates.is_core().alias("core")), "id")
    return best.select(F.col("asked_id").alias("item_id"), "id", "score", F.when((F.col("score") > 75) & ~F.col("core"), "merge").otherwise("create").alias("verdict"))


# --- conversations

TURNS_SQL = "SELECT conv_id, turn, '[' || CASE WHEN role IN ('user', 'human') THEN '用户' ELSE 'AI' END || '] ' || text AS line FROM conversations"


@query("turn_lines", TURNS_SQL)
def turn_lines(spark, d):
    return turn_table(spark, d).select("conv_id", "turn", text.turn_line(F.col("role"), F.col("text")).alias("line"))


@query("last_queries", "SELECT conv_id, arg_max(text, turn) FILTER (WHERE role = 'user' AND trim(text) <> '') AS query, CASE WHEN arg_max(role, turn) FILTER (WHERE role <> 'system') = 'user' THEN arg_max(text, turn) FILTER (WHERE role <> 'system') END AS current_query FROM conversations GROUP BY conv_id")
def last_queries(spark, d):
    return turns.last_messages(turn_table(spark, d))


CHUNKS = f"""
WITH RECURSIVE l AS (SELECT conv_id, turn, line, CASE WHEN turn % 3 = 0 THEN '' ELSE 't' || turn END AS said, {sql.tokens('line')} AS tok, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({TURNS_SQL})),
f AS (SELECT conv_id, turn, line, said, tok, n, 0::BIGINT AS chunk, tok::BIGINT AS size, tok > 450 AS alone FROM l WHERE n = 1
  UNION ALL SELECT l.conv_id, l.turn, l.line, l.said, l.tok, l.n,
    CASE WHEN l.tok > 450 OR f.alone OR f.size + l.tok > 300 THEN f.chunk + 1 ELSE f.chunk END,
    CASE WHEN l.tok > 450 OR f.alone OR f.size + l.tok > 300 THEN l.tok ELSE f.size + l.tok END, l.tok > 450
  FROM f JOIN l ON l.conv_id = f.conv_id AND l.n = f.n + 1)
SELECT conv_id, chunk, string_agg(line, chr(10) ORDER BY n) AS content, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turn_count, sum(tok)::BIGINT AS tokens, coalesce(arg_min(said, n) FILTER (WHERE said <> ''), '') AS timestamp_start, arg_max(said, n) AS timestamp_end FROM f GROUP BY conv_id, chunk
"""


@query("turn_chunks", CHUNKS)
def turn_chunks(spark, d):
    """Chunks with the first and last time; the test turns have no times, so some are made up."""
    return turns.chunks(turn_table(spark, d).withColumn("timestamp", F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat(F.lit("t"), F.col("turn").cast("string")))), 300)


@query("plain_log_turns", "SELECT conv_id AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def plain_log_turns(spark, d):
    """Each conversation written as a plain log with role prefixes, and read back."""
    c = turn_table(spark, d)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("AI:"), "text")
    logs = c.groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return turns.plain_turns(logs)


# --- writes

SNAPSHOT = "id, importance, type, store, pinned, resolved, valence, last_active"


@query(
    "update_snapshot",
    MEM + f"""SELECT id, CASE WHEN id % 11 = 0 THEN 10 WHEN id % 9 = 0 AND NOT (pinned OR protected) THEN 8 ELSE importance END::INT AS importance,
  CASE WHEN id % 11 = 0 AND type <> 'permanent' THEN 'permanent' WHEN id % 6 = 0 AND type NOT IN ('permanent', 'feel') THEN 'archived' ELSE type END AS type,
  CASE WHEN id % 11 = 0 AND type <> 'permanent' THEN 'permanent' WHEN id % 6 = 0 AND type NOT IN ('permanent', 'feel') THEN 'archive' ELSE store END AS store,
  id % 11 = 0 OR pinned AS pinned, id % 6 = 0 OR resolved AS resolved, CASE WHEN id % 9 = 0 THEN 1::DOUBLE ELSE valence END AS valence,
  CASE WHEN id % 6 = 0 OR id % 9 = 0 OR id % 11 = 0 THEN {sql.NOW} ELSE last_active END AS last_active FROM mem""",
)
def update_snapshot(spark, d):
    m, k = memories(spark, d), F.col("id")
    patches = m.where((k % 6 == 0) | (k % 9 == 0) | (k % 11 == 0)).select("id", F.when(k % 9 == 0, 8).alias("importance"), F.when(k % 9 == 0, 1.7).alias("valence"), F.when(k % 11 == 0, True).alias("pinned"), F.when(k % 6 == 0, True).alias("resolved"))
    return writes.updated(m, patches, now_column()).select(*SNAPSHOT.split(", "))


@query("delete_snapshot", MEM + "SELECT id, name FROM mem WHERE id % 8 <> 0")
def delete_snapshot(spark, d):
    m = memories(spark, d)
    return writes.deleted(m, m.where("id % 8 = 0")).select("id", "name")


@query("archive_snapshot", MEM + "SELECT id, CASE WHEN id % 8 = 0 THEN 'archived' ELSE type END AS type, CASE WHEN id % 8 = 0 THEN 'archive' ELSE store END AS store FROM mem")
def archive_snapshot(spark, d):
    m = memories(spark, d)
    return writes.archived(m, m.where("id % 8 = 0")).select("id", "type", "store")


@query("created_rows", "SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN doc_id::VARCHAR ELSE source END AS name, CASE WHEN doc_id % 4 = 0 THEN '未分类' ELSE lang END AS domain, least(1, (doc_id % 13)::DOUBLE / 10) AS valence, CASE WHEN doc_id % 5 = 0 THEN 10 ELSE greatest(1, least(10, doc_id % 14 - 1)) END::INT AS importance, CASE WHEN doc_id % 5 = 0 THEN 'permanent' WHEN doc_id % 7 = 0 THEN 'feel' ELSE 'dynamic' END AS store, CASE WHEN doc_id % 7 = 0 THEN 'feel' ELSE 'dynamic' END AS type FROM documents")
def created_rows(spark, d):
    k = F.col("doc_id")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(
        k.alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("source")).alias("name"), F.array("lang").alias("tags"), F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang")).alias("domain"), F.col("text").alias("content"),
        (k % 13 / F.lit(10.0)).alias("valence"), F.lit(None).cast("double").alias("arousal"), (k % 14 - 1).cast("int").alias("importance"), F.when(k % 7 == 0, "feel").alias("type"), (k % 5 == 0).alias("pinned"), F.lit(False).alias("protected"),
    )
    return writes.created(rows, now_column()).select("id", "name", F.get("domain", F.lit(0)).alias("domain"), "valence", "importance", "store", "type")


@query("vector_upsert", "SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT vec_id + 1000000, 2 FROM embeddings WHERE vec_id % 4 = 0")
def vector_upsert(spark, d):
    old = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit(1).alias("version"))
    new = old.where("id % 4 = 0").select("id", F.lit(2).alias("version"))
    return writes.upserted(old, new.unionByName(new.select((F.col("id") + 1_000_000).alias("id"), "version")), "id", "version")


@query("merge_snapshot", MEM + "SELECT id, CASE WHEN id % 5 = 0 THEN round((valence + 0.354::DOUBLE) / 2, 2) ELSE valence END AS valence, CASE WHEN id % 5 = 0 THEN greatest(importance, 6) ELSE importance END::INT AS importance, CASE WHEN id % 5 = 0 THEN array_to_string(list_sort(list_distinct(list_concat(tags, ['en', 'zz']))), ',') ELSE array_to_string(tags, ',') END AS tags, length(content) + CASE WHEN id % 5 = 0 THEN 5 ELSE 0 END AS size FROM mem")
def merge_snapshot(spark, d):
    m = memories(spark, d)
    news = m.where("id % 5 = 0").select("id", F.lit("new").alias("content"), F.array(F.lit("en"), F.lit("zz")).alias("tags"), F.array(F.lit("en")).alias("domain"), F.lit(0.354).alias("valence"), F.lit(0.5).alias("arousal"), F.lit(6).alias("importance"))
    return writes.merged(m, news, now_column()).select("id", "valence", "importance", F.array_join("tags", ",").alias("tags"), F.length("content").cast("long").alias("size"))


@query("review_snapshot", MEM + "SELECT id, CASE WHEN id % 5 = 1 THEN 10 WHEN id % 5 = 0 AND NOT (pinned OR protected) THEN 9 WHEN id % 5 = 2 AND NOT (pinned OR protected) THEN 1 ELSE importance END::INT AS importance, pinned OR id % 5 = 1 AS pinned, resolved OR id % 5 = 2 AS resolved, CASE WHEN id % 5 = 1 AND type <> 'permanent' THEN 'permanent' WHEN id % 5 = 2 AND type NOT IN ('permanent', 'feel') THEN 'archived' ELSE type END AS type, CASE WHEN id % 5 < 3 THEN " + sql.NOW + " ELSE last_active END AS last_active FROM mem WHERE id % 5 <> 3")
def review_snapshot(spark, d):
    m = memories(spark, d)
    actions = F.element_at(F.array(*[F.lit(a) for a in ("important", "pin", "noise", "delete", "other")]), (F.col("id") % 5 + 1).cast("int"))
    return writes.reviewed(m, m.select("id", actions.alias("action")), now_column()).select("id", "importance", "pinned", "resolved", "type", "last_active")


DECAY = MEM + f", c AS (SELECT *, {sql.CAN_DREAM} AND store <> 'archive' AS checked FROM scored), y AS (SELECT *, checked AND NOT resolved AND importance <= 4 AND days > 30 AS auto_resolved, checked AND score < 0.3 AS faded FROM c) "


@query("decay_cycle", DECAY + "SELECT id, score, resolved OR auto_resolved AS resolved, CASE WHEN faded OR auto_resolved THEN 'archived' ELSE type END AS type, CASE WHEN faded OR auto_resolved THEN 'archive' ELSE store END AS store, CASE WHEN auto_resolved THEN " + sql.NOW + " ELSE last_active END AS last_active FROM y")
def decay_cycle(spark, d):
    return writes.decay_cycle(scored(spark, d), F.col("score"), now_column()).select("id", "score", "resolved", "type", "store", "last_active")


@query("decay_stats", DECAY + "SELECT count(*) FILTER (WHERE checked) AS checked, count(*) FILTER (WHERE faded) AS archived, count(*) FILTER (WHERE auto_resolved) AS auto_resolved, coalesce(min(score) FILTER (WHERE checked), 0) AS lowest_score FROM y")
def decay_stats(spark, d):
    return writes.decay_stats(writes.decay_cycle(scored(spark, d), F.col("score"), now_column()))


TOUCH_SQL = with_(sql.MEM, sql.ROUNDS) + f", hit AS (SELECT bucket_id AS id, count(*) AS hits FROM rounds GROUP BY 1), p AS (SELECT a.id AS source, b.id AS target, row_number() OVER (PARTITION BY a.id ORDER BY b.seq) AS nth FROM mem a JOIN hit h ON h.id = a.id JOIN mem b ON a.id <> b.id AND abs(epoch(a.created) - epoch(b.created)) <= 48 * 3600 WHERE b.store <> 'archive' AND b.type NOT IN ('permanent', 'feel') AND NOT b.pinned AND NOT b.protected), w AS (SELECT target AS id, sum(hits) AS waves FROM p JOIN hit h ON h.id = p.source WHERE nth <= 5 GROUP BY 1) SELECT m.id, round(m.activation_count + coalesce(hits, 0) + coalesce(waves, 0) * 0.3::DOUBLE, 1) AS activation_count, CASE WHEN hits IS NOT NULL THEN {sql.NOW} ELSE last_active END AS last_active FROM mem m LEFT JOIN hit USING (id) LEFT JOIN w USING (id)"


@query("touch_snapshot", TOUCH_SQL)
def touch_snapshot(spark, d):
    return writes.touched(memories(spark, d), rounds(spark, d).select(F.col("bucket_id").alias("id")), now_column()).select("id", "activation_count", "last_active")


@query("touch_changes", TOUCH_SQL + " WHERE hits IS NOT NULL OR waves IS NOT NULL")
def touch_changes(spark, d):
    """The rows that a log of touches changes, as a write to the change log holds them."""
    touches = rounds(spark, d).select(F.col("bucket_id").alias("id"))
    return change_log.touch_changes(memories(spark, d), touches, now_column()).select("id", "activation_count", "last_active")


@query("touch_laid_over", TOUCH_SQL)
def touch_laid_over(spark, d):
    """The table after two writes of changed rows, the touches and before them a wrong value of the same rows: the newest counts."""
    m = memories(spark, d)
    rows = change_log.touch_changes(m, rounds(spark, d).select(F.col("bucket_id").alias("id")), now_column())
    older = m.select("id").join(rows.select("id"), "id", "left_semi").join(m.withColumn("activation_count", F.lit(-1.0)), "id")
    marked = lambda x, v: x.select(*m.columns, F.lit(False).alias(change_log.REMOVED), F.lit(v).alias(change_log.VERSION))
    return change_log.laid_over(m, marked(older, 1).unionByName(marked(rows, 2))).select("id", "activation_count", "last_active")


@query("summary_cache", MEM + f"SELECT id, sha256(content) AS content_hash, CASE WHEN id % 2 = 0 THEN 'cached' ELSE {sql.summary()} END AS summary FROM mem")
def summary_cache(spark, d):
    """Summaries by content hash: cached ones are joined, only misses are made."""
    m = memories(spark, d).withColumn("content_hash", text.content_hash(F.col("content"))).withColumn("owner", F.col("id"))
    cache = m.where("id % 2 = 0").select("content_hash", F.col("id").alias("owner"), F.lit("cached").alias("stored"))
    return m.join(cache, ["content_hash", "owner"], "left").select("id", "content_hash", F.coalesce("stored", plans.summary(F.col("content"))).alias("summary"))


