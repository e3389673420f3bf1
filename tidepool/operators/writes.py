"""Writes as new snapshots: each takes a memory table and returns the one after the write. Nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.config import DecaySettings
from tidepool.functions.scoring import clamp, flag, merged_average
from tidepool.functions.text import safe_name
from tidepool.operators.pairs import first_within
from tidepool.operators.predicates import decays, fades, is_core, resolves_itself, ripples, type_in

DEFAULT_DOMAIN = "未分类"
PATCHABLE = ("name", "tags", "domain", "content", "valence", "arousal", "model_valence", "importance", "activation_count", "pinned", "protected", "resolved", "digested")


def created(rows: DataFrame, now: Column) -> DataFrame:
    """New memories: values clamped, a default domain, importance 10 and the permanent store for pinned ones."""
    locked = flag(F.col("pinned")) | flag(F.col("protected"))
    kind = F.coalesce("type", F.lit("dynamic"))
    return rows.select(
        "id", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("id").cast("string")).alias("name"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.when(F.coalesce(F.size("domain"), F.lit(0)) > 0, F.col("domain")).otherwise(F.array(F.lit(DEFAULT_DOMAIN))).alias("domain"), "content",
        clamp(F.coalesce("valence", F.lit(0.5)), 0, 1).alias("valence"), clamp(F.coalesce("arousal", F.lit(0.3)), 0, 1).alias("arousal"),
        F.when(locked, 10).otherwise(clamp(F.coalesce("importance", F.lit(5)).cast("double"), 1, 10).cast("int")).alias("importance"), F.lit(1.0).alias("activation_count"), kind.alias("type"),
        F.when((kind == "permanent") | flag(F.col("pinned")), "permanent").when(kind == "feel", "feel").otherwise("dynamic").alias("store"),
        flag(F.col("pinned")).alias("pinned"), flag(F.col("protected")).alias("protected"), F.lit(False).alias("resolved"), F.lit(False).alias("digested"),
        now.alias("created"), now.alias("last_active"),
    )


def updated(memory: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """``memory`` with ``patches`` (id and any of PATCHABLE; null leaves a value as it is), one patch an id.

    What is pinned or protected already keeps its importance. Pinning sets it to 10 and makes the row permanent;
    otherwise resolving archives all but permanent memories and feelings. A patched row was active now.
    """
    given = [c for c in patches.columns if c in PATCHABLE]
    p = patches.select("id", *[F.col(c).alias(f"new_{c}") for c in given], F.lit(True).alias("patched"))
    both = memory.join(p, "id", "left")
    new = lambda c: F.col(f"new_{c}") if c in given else F.lit(None).cast(memory.schema[c].dataType)
    hit, locked = F.col("patched").isNotNull(), is_core()
    pinning = hit & flag(new("pinned"))
    moves = pinning & ~type_in("permanent")
    resolving = hit & flag(new("resolved")) & ~type_in("permanent", "feel") & ~moves
    values = {c: F.coalesce(new(c), F.col(c)) for c in given}
    for c in ("valence", "arousal", "model_valence"):
        if c in values:
            values[c] = F.coalesce(clamp(new(c), 0.0, 1.0), F.col(c))
    if "name" in values:
        values["name"] = F.when(new("name").isNotNull(), safe_name(new("name"))).otherwise(F.col("name"))
    importance = F.coalesce(F.when(~locked, clamp(new("importance").cast("double"), 1, 10).cast("int")), F.col("importance"))
    values["importance"] = F.when(pinning, 10).otherwise(importance)
    values["type"] = F.when(moves, "permanent").when(resolving, "archived").otherwise(F.col("type"))
    values["store"] = F.when(moves, "permanent").when(resolving, "archive").otherwise(F.col("store"))
    values["last_active"] = F.when(hit, now).otherwise(F.col("last_active"))
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in memory.columns])


def found(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``table`` whose id is asked for; ids that it lacks give none."""
    return table.join(ids.select("id").distinct(), "id", "left_semi")


def deleted(memory: DataFrame, ids: DataFrame) -> DataFrame:
    return memory.join(ids.select("id").distinct(), "id", "left_anti")


def archived(memory: DataFrame, ids: DataFrame) -> DataFrame:
    hit = F.col("gone").isNotNull()
    both = memory.join(ids.select("id").distinct().withColumn("gone", F.lit(True)), "id", "left")
    return both.withColumn("type", F.when(hit, "archived").otherwise(F.col("type"))).withColumn("store", F.when(hit, "archive").otherwise(F.col("store"))).select(*memory.columns)


def upserted(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return table.unionByName(rows).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def merged(memory: DataFrame, news: DataFrame, now: Column) -> DataFrame:
    """``memory`` with ``news`` (id, content, tags, domain, valence, arousal, importance) merged in: texts joined, moods averaged, lists united."""
    n = news.select("id", *[F.col(c).alias(f"new_{c}") for c in ("content", "tags", "domain", "valence", "arousal", "importance")])
    both = memory.join(n, "id", "left")
    hit = F.col("new_content").isNotNull()
    values = {
        "content": F.concat("content", F.lit("\n\n"), "new_content"), "tags": F.array_sort(F.array_union("tags", "new_tags")), "domain": F.array_sort(F.array_union("domain", "new_domain")),
        "valence": merged_average(F.col("valence"), F.col("new_valence")), "arousal": merged_average(F.col("arousal"), F.col("new_arousal")),
        "importance": F.greatest("importance", "new_importance"), "last_active": now,
    }
    return both.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in memory.columns])


def reviewed(memory: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Decisions (id, action): important raises to 9, pin pins, noise resolves and lowers to 1, all as updates; delete deletes; others change nothing."""
    act = lambda name: F.col("action") == name
    patches = decisions.where(F.col("action").isin("important", "pin", "noise")).select(
        "id", F.when(act("important"), 9).when(act("noise"), 1).alias("importance"), F.when(act("pin"), True).alias("pinned"), F.when(act("noise"), True).alias("resolved")
    )
    return updated(deleted(memory, decisions.where(act("delete"))), patches, now)


def digested(memory: DataFrame, feelings: DataFrame, now: Column) -> DataFrame:
    """``memory`` in which the sources of ``feelings`` (source, valence) are digested and hold the feeling's valence, if that is one; the last of several counts."""
    felt = F.when(F.col("valence").between(0, 1), F.col("valence"))
    patches = feelings.where("source IS NOT NULL").groupBy(F.col("source").alias("id")).agg(F.max_by(felt, F.when(felt.isNotNull(), F.col("new_id"))).alias("model_valence"))
    return updated(memory, patches.withColumn("digested", F.lit(True)), now)


def decay_cycle(memory: DataFrame, score: Column, now: Column, s: DecaySettings = DecaySettings()) -> DataFrame:
    """One pass over a snapshot: what resolves itself, which is an update, and what fades. Both are judged on the snapshot's values."""
    checked = decays() & (F.col("store") != "archive")
    resolves = checked & resolves_itself(F.col("days"), s)
    out = memory.withColumn("checked", checked).withColumn("auto_resolved", resolves).withColumn("score", score)
    out = out.withColumn("faded", F.col("checked") & fades(F.col("score"), s))
    gone = F.col("faded") | F.col("auto_resolved")
    out = out.withColumn("last_active", F.when(F.col("auto_resolved"), now).otherwise(F.col("last_active"))).withColumn("resolved", flag(F.col("resolved")) | F.col("auto_resolved"))
    return out.withColumn("type", F.when(gone, "archived").otherwise(F.col("type"))).withColumn("store", F.when(gone, "archive").otherwise(F.col("store")))


def decay_stats(cycle: DataFrame) -> DataFrame:
    return cycle.agg(
        F.count_if("checked").alias("checked"), F.count_if("faded").alias("archived"), F.count_if("auto_resolved").alias("auto_resolved"), F.coalesce(F.min(F.when(F.col("checked"), F.col("score"))), F.lit(0.0)).alias("lowest_score")
    )


def ripple_targets(memory: DataFrame, touched: DataFrame, hours: int = 48, most: int = 5) -> DataFrame:
    """(source, target, nth, gap_hours): for each touched row the first rows in scan order that were created within ``hours`` of it."""
    sources = memory.join(touched.select("id").distinct(), "id", "left_semi")
    return first_within(sources, memory.where(ripples() & (F.col("store") != "archive")), hours, most)


def touch_waves(memory: DataFrame, activations: DataFrame) -> DataFrame:
    """(id, hits, waves): how often each row was touched, and how many touches reached it as a ripple."""
    direct = activations.groupBy("id").agg(F.count("*").alias("hits"))
    ripple = ripple_targets(memory, activations).join(direct.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.sum("hits").alias("waves"))
    return direct.join(ripple, "id", "full")


def with_waves(memory: DataFrame, waves: DataFrame, how: str, now: Column, spread: float) -> DataFrame:
    count = F.round(F.coalesce("activation_count", F.lit(1.0)) + F.coalesce("hits", F.lit(0)) + F.coalesce("waves", F.lit(0)) * F.lit(spread), 1)
    both = memory.join(waves, "id", how)
    return both.withColumn("activation_count", count).withColumn("last_active", F.when(F.col("hits").isNotNull(), now).otherwise(F.col("last_active"))).select(*memory.columns)


def touched(memory: DataFrame, activations: DataFrame, now: Column, spread: float = 0.3) -> DataFrame:
    """``memory`` after a log of ``activations`` (id): each counts 1 for its row and ``spread`` for its ripple targets.

    The log is materialised first, so a plan that is run twice doesn't touch twice. ``change_log.touch_changes`` gives the changed rows alone.
    """
    return with_waves(memory, touch_waves(memory, activations), "left", now, spread)
