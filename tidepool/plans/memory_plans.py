"""What an agent asks of its memory, as plans over the memory table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import DecaySettings, RecallSettings, SearchSettings
from tidepool.functions import scoring, text
from tidepool.operators import fuzzy_search, pairs, predicates, ranking, writes
from tidepool.operators.packing import pack, pack_joined
from tidepool.runtime import cut

MOST_RESULTS, MOST_TOKENS = 50, 20_000


def with_score(memory: DataFrame, s: DecaySettings = DecaySettings()) -> DataFrame:
    c = F.col
    return memory.withColumn("score", scoring.decay_score(c("type"), c("importance"), c("activation_count"), c("days"), c("arousal"), c("resolved"), c("digested"), c("pinned"), c("protected"), s))


def summary(body: Column) -> Column:
    """A deterministic stand-in for a model's summary: the first 200 characters without links, below the header."""
    c = F.col
    return F.concat(text.summary_header(c("name"), c("domain"), c("valence"), c("arousal"), c("model_valence"), c("digested")), text.without_links(F.left(body, F.lit(200))))


def surface(memory: DataFrame, k: int = 20, max_tokens: int = 10_000, seed: int | None = None) -> DataFrame:
    """(id, score, tokens, used): unresolved memories by decay score, as many as the budget holds that the core memories leave."""
    k, max_tokens = min(k, MOST_RESULTS), min(max_tokens, MOST_TOKENS)
    live = memory.where(F.col("store") != "archive")
    core = live.where(predicates.is_core()).agg(F.coalesce(F.sum(text.token_estimate(summary(F.col("content")))), F.lit(0)).alias("core_tokens"))
    best = with_score(live.where(predicates.can_surface())).select("id", "score", text.token_estimate(summary(F.col("content"))).alias("tokens")).orderBy(F.desc("score"), "id").limit(k)
    if seed is not None:
        from pyspark.sql import Window

        best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
        order = ranking.mixed(F.col("rank"), F.col("id"), seed)
    else:
        order = [F.desc("score"), F.col("id")]
    return pack(best.join(F.broadcast(core)), F.lit(max_tokens) - F.col("core_tokens"), order).select("id", "score", "tokens", "used")  # core is one row


def relevance(memory: DataFrame, topic: Column, valence: float | None, arousal: float | None, s: SearchSettings = SearchSettings()) -> DataFrame:
    """``memory`` with the parts of the search score and the score, not yet rounded."""
    asked = lambda x: F.lit(x).cast("double")
    parts = memory.withColumn("topic", topic).withColumn("emotion", scoring.emotion_match(asked(valence), asked(arousal), F.col("valence"), F.col("arousal"))).withColumn("time", scoring.time_proximity(F.col("days"))).withColumn("weight", scoring.importance_share(F.col("importance")))
    return parts.withColumn("relevance", scoring.search_score(F.col("topic"), F.col("emotion"), F.col("time"), F.col("weight"), F.col("resolved"), s))


def breakdown(memory: DataFrame, topic: Column, valence: float | None = None, arousal: float | None = None, s: SearchSettings = SearchSettings()) -> DataFrame:
    """The parts of the score to four places, the sum, the score to two, and whether it passes."""
    r = relevance(memory, topic, valence, arousal, s)
    raw = F.col("topic") * s.topic + F.col("emotion") * s.emotion + F.col("time") * s.time + F.col("weight") * s.importance
    return r.select("id", *[F.round(c, 4).alias(c) for c in ("topic", "emotion", "time", "weight")], F.round(raw, 4).alias("raw_total"), F.round("relevance", 2).alias("normalized"), (F.col("relevance") >= s.threshold).alias("passed"))


def keyword_hits(memory: DataFrame, topic: Column, k: int, valence: float | None = None, arousal: float | None = None, s: SearchSettings = SearchSettings()) -> DataFrame:
    live = memory.where(F.col("store") != "archive")
    kept = relevance(live, topic, valence, arousal, s).where(F.col("relevance") >= s.threshold).withColumn("score", F.round("relevance", 2))
    return kept.orderBy(F.desc("score"), "id").limit(k)


BREATH_COLUMNS = "id", "content", "name", "domain", "valence", "arousal", "model_valence", "digested"
#: Fixed values of drifting: fewer hits than the first, this share of such searches, at most so many faint memories below that score.
FEW_HITS, DRIFT_SHARE, MOST_DRIFTED, FAINT = 3, 0.4, 3, 2.0
DRIFT_POOL = 64


def breath(memory: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 20, max_tokens: int = 10_000, floor: float = 0.5, seed: int = 0, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(asked_id, channel, id, score, valence, tokens, used): what each of ``queries`` (asked_id, query, domains, asked, valence, arousal) brings to mind.

    Channel 0 are fuzzy hits by words, 1 are vector hits that they lack, packed into the budget in this order; 2 are faint
    memories that drift up where few were hit. Both searches are limited before core memories are taken out, so these use
    up places. Vector hits may be archived. A memory's valence is shown as coloured by the mood of the query. Which searches
    drift, and what drifts, follows from hashes of the seed: a pool of DRIFT_POOL faint memories, from which each takes its own.
    """
    k = max(min(k, MOST_RESULTS), 20)
    moods = queries.select("asked_id", F.col("valence").alias("mood"))
    words = fuzzy_search.fuzzy_hits(memory, queries.select("asked_id", "query", "domains", "valence", "arousal"), k, s=s)
    near = pairs.nearest_each(vectors, queries.select("asked_id", "asked").where("asked IS NOT NULL"), k).where(F.col("similarity") > floor)
    others = near.join(words.select("asked_id", "id"), ["asked_id", "id"], "left_anti").select("asked_id", "id", F.round(F.col("similarity") * 100, 2).alias("score"), F.lit(1).alias("channel"))
    hits = words.select("asked_id", "id", "score", F.lit(0).alias("channel")).unionByName(others)
    # A summary takes no more of a content. Core memories are left out of both channels at once: those that words hit, vectors hit in vain.
    told = memory.where(~predicates.is_core()).select(*[c for c in BREATH_COLUMNS if c != "content"], F.left("content", F.lit(200)).alias("content"))
    both = cut(hits.join(told, "id").join(moods, "asked_id"))
    shown = both.withColumn("valence", scoring.mood_shift(scoring.number(F.col("valence"), 0.5), F.col("mood"))).withColumn("tokens", text.token_estimate(summary(F.col("content"))))
    packed = pack(shown, F.lit(min(max_tokens, MOST_TOKENS)), [F.col("channel"), F.desc("score"), F.col("id")], keys=("asked_id",)).select("asked_id", "channel", "id", "score", "valence", "tokens", "used")
    return packed.unionByName(_drifted(memory, queries, both, seed))


def _drifted(memory: DataFrame, queries: DataFrame, hits: DataFrame, seed: int) -> DataFrame:
    chance = lambda *c: F.pmod(F.xxhash64(*c, F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    faint = with_score(memory.where(F.col("store") != "archive")).where(F.col("score") < FAINT).select("id", "score").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(DRIFT_POOL)
    pool = faint.agg(F.collect_list(F.struct("id", "score")).alias("pool"))
    met = queries.where(F.trim(F.coalesce("query", F.lit(""))) != "").select("asked_id").join(hits.groupBy("asked_id").agg(F.collect_list("id").alias("met")), "asked_id", "left").withColumn("met", F.coalesce("met", F.array().cast("array<long>")))
    few = met.where((F.size("met") < FEW_HITS) & (chance(F.col("asked_id"), F.lit("drifts")) < DRIFT_SHARE)).join(F.broadcast(pool))  # one row of DRIFT_POOL
    left = F.filter("pool", lambda x: ~F.array_contains("met", x["id"]))
    own = F.transform(F.array_sort(F.transform(left, lambda x: F.struct(F.xxhash64(x["id"], "asked_id", F.lit(seed)).alias("place"), x["id"].alias("id"), x["score"].alias("score")))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score")))
    some = few.select("asked_id", F.inline(F.slice(own, 1, F.floor(chance(F.col("asked_id"), F.lit("how many")) * MOST_DRIFTED).cast("int") + 1)))
    return some.select("asked_id", F.lit(2).alias("channel"), "id", "score", F.lit(None).cast("double").alias("valence"), F.lit(None).cast("int").alias("tokens"), F.lit(None).cast("long").alias("used"))


def after_breath(memory: DataFrame, told: DataFrame, now: Column) -> DataFrame:
    """``memory`` once the hits of a ``breath`` were touched; what only drifted up wasn't."""
    return writes.touched(memory, cut(told.where("channel < 2").select("id")), now)


def word_topic(words: list[str]) -> Column:
    """A topic score that SQL can express: the share of words that the content holds."""
    return sum((F.contains(F.lower("content"), F.lit(w.lower())).cast("int") for w in words), F.lit(0)) / F.lit(float(len(words)))


def word_hits(memory: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(session_id, id, score): the ``k`` memories that hold most of the words of each of ``queries`` (session_id, query), over all memories that can be recalled.

    The score is the share of the query's different words. Memories that share no word aren't hits.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    held = memory.where(predicates.can_be_recalled()).select("id", words(F.col("content")).alias("words"))
    return pairs.most_shared(held, queries.select(F.col("session_id").alias("asked_id"), words(F.col("query")).alias("asked")), k).select(F.col("asked_id").alias("session_id"), "id", "score")


def recall(memory: DataFrame, keyword: DataFrame, semantic: DataFrame, rounds: DataFrame, now: Column, s: RecallSettings = RecallSettings()) -> DataFrame:
    """(session_id, id, score, rank): one or two cards a session of the candidates of both channels.

    ``keyword`` and ``semantic`` are (session_id, id, score) with at most ``top_k`` rows a session. Candidates that
    were injected lately cool down, and those of the last rounds are skipped unless nothing else is left.
    """
    met = keyword.select("session_id", "id", F.col("score").alias("k")).join(semantic.select("session_id", "id", F.col("score").alias("s")), ["session_id", "id"], "full_outer")
    own = met.join(memory.where(predicates.can_be_recalled()).select("id", "importance", "days"), "id")
    last = ranking.last_injections(rounds).withColumnRenamed("bucket_id", "id")
    hours = F.timestamp_diff("SECOND", F.col("injected_at"), now) / F.lit(3600.0)
    cooled = scoring.cooldown(hours, s)
    scored = own.join(last, ["session_id", "id"], "left").withColumn("score", scoring.recall_score(F.coalesce("s", F.lit(0.0)), F.coalesce("k", F.lit(0.0)), F.col("importance"), F.col("days"), cooled, s))
    recent = ranking.recent_rounds(rounds, s.skip_rounds).withColumnRenamed("bucket_id", "id")
    return ranking.cards(ranking.unless_recent(scored.select("session_id", "id", "score"), recent), s).select("session_id", "id", "score", "rank")


def dream(memory: DataFrame, k: int = 10) -> DataFrame:
    """The latest memories, with the lines a dream shows of them."""
    live = memory.where((F.col("store") != "archive") & predicates.can_dream()).orderBy(F.desc("created"), "id").limit(k)
    tag = F.when(scoring.flag(F.col("resolved")), " [已解决]").otherwise(" [未解决]")
    line = F.concat(F.lit("["), "name", F.lit("]"), tag, F.lit(" 主题:"), F.array_join("domain", ","), F.lit(" V"), text.one_decimal(F.col("valence")), F.lit("/A"), text.one_decimal(F.col("arousal")), F.lit("\nID: "), F.col("id").cast("string"), F.lit("\n"), text.without_links(F.left("content", F.lit(500))))
    return live.select("id", "created", line.alias("line"))


def best_pair(vectors: DataFrame, above: float) -> DataFrame:
    """The most similar pair among few rows, if any is similar enough."""
    return pairs.similar_pairs(vectors, above, 1).select("source", "target", F.round("similarity", 4).alias("similarity")).orderBy(F.desc("similarity"), "source", "target").limit(1)


def pulse(memory: DataFrame) -> DataFrame:
    c = F.col
    line = F.concat(
        text.status_icon(c("type"), c("resolved"), c("pinned"), c("protected")), F.lit(" ["), c("name"), F.lit("]"), F.when(scoring.flag(c("resolved")), " [已解决]").otherwise(""), F.lit(" bucket_id:"), c("id").cast("string"),
        F.lit(" 主题:"), F.array_join("domain", ","), F.lit(" 情感:V"), text.one_decimal(c("valence")), F.lit("/A"), text.one_decimal(c("arousal")), F.lit(" 重要:"), c("importance").cast("string"),
        F.lit(" 权重:"), F.format_string("%.2f", F.round("score", 2)), F.lit(" 标签:"), F.array_join("tags", ","),
    )
    return with_score(memory).select("id", line.alias("line"))


def feelings(memory: DataFrame, budget: int) -> DataFrame:
    """Feelings, latest first, up to the one that exceeds the budget of their joined text.

    A line counts at least 0.05 tokens for the character that joins it, so no more than 20 lines a token can fit.
    """
    lines = memory.where((F.col("type") == "feel") & (F.col("store") != "archive")).select("id", "created", text.without_links(F.left("content", F.lit(200))).alias("line")).orderBy(F.desc("created"), "id").limit(20 * (budget + 1) + 2)
    return pack_joined(lines, budget, [F.desc("created"), F.col("id")]).select("id", "total")
