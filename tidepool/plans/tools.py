"""The agent's writing tools as plans: each returns the memory after it, and what it did with every input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import SearchSettings
from tidepool.functions import answers
from tidepool.operators import fuzzy_search, predicates, writes
from tidepool.sources.memory import MEMORY

SHORT_TEXT = 30


def merge_targets(memory: DataFrame, news: DataFrame, s: SearchSettings = SearchSettings()) -> DataFrame:
    """(new_id, id, score): for each of ``news`` (new_id, content, domain) the memory to merge it into, if its best match is good and free.

    The best match within the new text's domains is taken as it is: if it is pinned or not good enough, the text stands
    alone. A text without domains, or of domains that no live memory has, is matched with all live memories.
    """
    queries = news.select(F.col("new_id").alias("asked_id"), F.col("content").alias("query"), F.col("domain").alias("domains"), F.lit(None).cast("double").alias("valence"), F.lit(None).cast("double").alias("arousal"))
    # A match that isn't over the threshold is no target, whether a better one exists or not.
    best = fuzzy_search.fuzzy_hits(memory, queries, 1, s.merge_threshold, s).join(memory.select("id", predicates.is_core().alias("core")), "id")
    return best.where((F.col("score") > s.merge_threshold) & ~F.col("core")).select(F.col("asked_id").alias("new_id"), "id", "score")


def hold(memory: DataFrame, news: DataFrame, now: Column, s: SearchSettings = SearchSettings()) -> tuple[DataFrame, DataFrame]:
    """(memory after, (new_id, id, outcome)) of ``news`` (new_id, content, domain, tags, valence, arousal, importance, pinned, type, and perhaps source).

    Pinned texts and feelings are always created; others merge into their target or are created under ``new_id``. The
    memory that is the ``source`` of a feeling is digested.
    """
    own = F.coalesce("pinned", F.lit(False)) | (F.coalesce("type", F.lit("dynamic")) == "feel")
    targets = merge_targets(memory, news.where(~own), s)
    decided = news.join(targets, "new_id", "left")
    merging = decided.where(F.col("id").isNotNull())
    # Several texts for one memory are merged as one.
    parts = merging.groupBy("id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("new_id", "content"))), lambda x: x["content"]), "\n\n").alias("content"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"),
        F.array_distinct(F.flatten(F.collect_list("domain"))).alias("domain"), F.avg("valence").alias("valence"), F.avg("arousal").alias("arousal"), F.max("importance").alias("importance"),
    )
    made = writes.created(decided.where(F.col("id").isNull()).drop("id").select(F.col("new_id").alias("id"), F.lit(None).cast("string").alias("name"), "content", "tags", "domain", "valence", "arousal", "importance", "pinned", F.lit(False).alias("protected"), "type"), now)
    columns = [f.name for f in MEMORY.fields if f.name in memory.columns]
    after = writes.merged(memory.select(*columns), parts, now).unionByName(made.select(*[c for c in columns if c in made.columns]), allowMissingColumns=True)
    if "source" in news.columns:
        after = writes.digested(after, news.where("type = 'feel'"), now)
    return after, decided.select("new_id", F.coalesce("id", "new_id").alias("id"), F.when(F.col("id").isNull(), "created").otherwise("merged").alias("outcome"))


def grown(diary: DataFrame, first_id: int) -> DataFrame:
    """News for ``hold`` from split answers (diary_id, text, answer): a short text is its own only item, an unreadable answer gives none."""
    own = F.array(F.struct(F.lit("").alias("name"), F.col("text").alias("content"), F.array(F.lit(answers.NO_DOMAIN)).alias("domain"), F.lit(0.5).alias("valence"), F.lit(0.3).alias("arousal"), F.array().cast("array<string>").alias("tags"), F.lit(5).alias("importance")))
    listed = F.when(F.length("text") < SHORT_TEXT, own).otherwise(answers.items(F.col("answer")))
    rows = diary.select("diary_id", F.posexplode(listed).alias("pos", "item"))
    return rows.select((F.lit(first_id) + F.col("diary_id") * 1000 + F.col("pos")).alias("new_id"), "item.*", F.lit(False).alias("pinned"), F.lit("dynamic").alias("type")).drop("name")


def trace(memory: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """``memory`` after ``patches`` of raw arguments (id, valence, arousal, importance, resolved, pinned, digested, delete): -1 leaves a value, others are checked."""
    ranged = lambda c, low, high: F.when(F.col(c).between(low, high), F.col(c)).alias(c)
    switch = lambda c: F.when(F.col(c).isin(0, 1), F.col(c) == 1).alias(c)
    kept = writes.deleted(memory, patches.where("delete = 1"))
    return writes.updated(kept, patches.where("delete <> 1").select("id", ranged("valence", 0, 1), ranged("arousal", 0, 1), ranged("importance", 1, 10), switch("resolved"), switch("pinned"), switch("digested")), now)


def routed(requests: DataFrame, upstreams: DataFrame) -> DataFrame:
    """(request_id, model, upstream) by the first upstream in order that lists the model; null if none does. ``upstreams`` (place, upstream, models)."""
    first = upstreams.select("place", "upstream", F.explode("models").alias("model")).groupBy("model").agg(F.min_by("upstream", "place").alias("upstream"))
    return requests.select("request_id", F.trim("model").alias("model")).join(first, "model", "left").select("request_id", "model", "upstream")


def normal_keywords(words: Column, stop: list[str], least: int = 2) -> Column:
    """Keywords without blanks, short ones, stop words and repeats, longest first."""
    clean = F.array_distinct(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (F.length(w) >= least) & ~F.lower(w).isin(*stop)))
    return F.transform(F.array_sort(F.transform(clean, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
