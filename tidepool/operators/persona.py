"""The persona: a log of evaluated messages, a profile that each of them moves a little, and what is shown of both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import PersonaSettings
from tidepool.functions.answers import AFFECT, PERSONALITY, RELATIONSHIP, evaluation
from tidepool.functions.scoring import clamp
from tidepool.functions.text import content_hash

#: Where a profile starts, and the advice when there is none.
START = {"openness": 0.56, "conscientiousness": 0.50, "extraversion": 0.44, "agreeableness": 0.66, "neuroticism": 0.36, "affinity": 0.86, "dominance": 0.38, "defensiveness": 0.12, "trust": 0.82}
STEADY = "保持稳定、温和、低压，不主动放大情绪。"
NO_ANSWER = "persona evaluation unavailable"
_ORDER = ["profile_id", "ts", "event_id"]
_RUN = "profile_id string, ts timestamp_ntz, event_id long, step array<double>, low array<double>, high array<double>, told timestamp_ntz, began timestamp_ntz"


def _has_text() -> Column:
    return F.trim(F.coalesce("message", F.lit(""))) != ""


def event_log(messages: DataFrame, s: PersonaSettings = PersonaSettings()) -> DataFrame:
    """One row for each message with text of (profile_id, session_id, event_id, ts, message, raw), raw the model's answer.

    The message itself is kept as a hash only. An answer without a JSON object leaves its fields null and sets ``error``.
    """
    said = messages.where(_has_text()).withColumn("e", evaluation(F.coalesce("raw", F.lit("")), s))
    fields = [F.col(f"e.{x}").alias(x) for x in ("event_type", "perceived_intent", "affect_delta", "relationship_delta", "personality_delta", "mood_label", "reply_guidance", "confidence")]
    return said.select("profile_id", "session_id", "event_id", "ts", content_hash(F.col("message")).alias("message_hash"), *fields, F.when(F.col("e").isNull(), NO_ANSWER).alias("error"))


def mood_events(messages: DataFrame, s: PersonaSettings = PersonaSettings()) -> DataFrame:
    """(session_id, event_id, ts, d_valence, d_arousal, d_defensiveness, mood_label) of all messages: blank ones and those without an evaluation change nothing but let time pass."""
    e = messages.select("session_id", "event_id", "ts", F.when(_has_text(), evaluation(F.coalesce("raw", F.lit("")), s)).alias("e"))
    deltas = {"d_valence": "affect_delta.valence", "d_arousal": "affect_delta.arousal", "d_defensiveness": "relationship_delta.defensiveness"}
    return e.select("session_id", "event_id", "ts", *[F.coalesce(F.col(f"e.{c}"), F.lit(0.0)).alias(a) for a, c in deltas.items()], F.col("e.mood_label").alias("mood_label"))


def listed_events(log: DataFrame, most: int = 20) -> DataFrame:
    """The newest ``most`` (1 to 100) events as they are listed: short hashes, defaults for what is missing."""
    text = lambda c, default="": F.coalesce(F.col(c), F.lit(default)).alias(c)
    newest = log.orderBy(F.desc("event_id")).limit(max(1, min(100, most)))
    return newest.select("event_id", "session_id", F.left("message_hash", F.lit(12)).alias("message_hash"), text("event_type", "unknown"), text("perceived_intent"), "affect_delta", "relationship_delta", "personality_delta", text("mood_label"), text("reply_guidance"), F.round(clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 1.0), 3).alias("confidence"), text("error"), "ts")


def _then(first: tuple, after: tuple) -> tuple:
    """Two maps in a row, each adding a step and then holding in low..high, as one map of that kind."""
    step, low, high = after
    return first[0] + step, np.clip(first[1] + step, low, high), np.clip(first[2] + step, low, high)


def _one_map(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows of ``steps`` in order, each added and then held in 0..1: neighbours are joined until one map is left."""
    maps = (steps, np.zeros_like(steps), np.ones_like(steps))
    while len(maps[0]) > 1:
        even = len(maps[0]) // 2 * 2
        pairs = _then(tuple(x[0:even:2] for x in maps), tuple(x[1:even:2] for x in maps))
        maps = tuple(np.concatenate([x, y[even:]]) for x, y in zip(pairs, maps, strict=True))
    return tuple(x[0] for x in maps)


def profiles(log: DataFrame, start: dict[str, float] = START) -> DataFrame:
    """(profile_id, the nine traits, updated_at) after all events of ``event_log``, in the order of (ts, event_id).

    Every session moves the same profile, so one profile may hold all events: they are dealt out by ranges of time, each
    range becomes one map of the traits (``_one_map``), and a profile's few maps are applied in order. Events without an
    evaluation move nothing; a profile that has only such ones keeps ``start``.
    """
    return _folded(log.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER), start)


def profiles_of(messages: DataFrame, start: dict[str, float] = START, s: PersonaSettings = PersonaSettings()) -> DataFrame:
    """``profiles`` of the log of ``messages``: these are dealt out before they are evaluated, so that each answer is read once, not for the ranges too."""
    said = messages.where(_has_text()).select("profile_id", "session_id", "event_id", "ts", "message", "raw")
    return _folded(event_log(said.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER), s), start)


def _folded(dealt: DataFrame, start: dict[str, float]) -> DataFrame:
    """``profiles`` of a log whose partitions are ranges in order."""
    names = [*PERSONALITY, *RELATIONSHIP]
    deltas = [F.coalesce(F.col(f"personality_delta.{k}"), F.lit(0.0)).alias(k) for k in PERSONALITY] + [F.coalesce(F.col(f"relationship_delta.{k}"), F.lit(0.0)).alias(k) for k in RELATIONSHIP]
    dealt = dealt.select(F.col("profile_id").cast("string").alias("profile_id"), "ts", F.col("event_id").cast("long").alias("event_id"), *deltas, F.when(F.col("error").isNull(), F.col("ts")).alias("told"))

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        later = lambda a, b, pick: b if pd.isna(a) else a if pd.isna(b) else pick(a, b)
        row = lambda at, done, told, began: pd.DataFrame([(*at, *done, told, began)], columns=["profile_id", "ts", "event_id", "step", "low", "high", "told", "began"])
        at, done, told, began = None, None, None, None
        for frame in frames:
            for _, rows in frame.groupby("profile_id", sort=False, dropna=False):
                first, new = rows.iloc[0], _one_map(rows[names].to_numpy(dtype=float))
                newest, oldest = rows.told.max(), rows.ts.min()
                if at is not None and first.profile_id == at[0]:
                    done, told, began = _then(done, new), later(told, newest, max), later(began, oldest, min)
                    continue
                if at is not None:
                    yield row(at, done, told, began)
                at, done, told, began = (first.profile_id, first.ts, first.event_id), new, newest, oldest
        if at is not None:
            yield row(at, done, told, began)

    listed = dealt.mapInPandas(runs, _RUN).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "step", "low", "high"))).alias("runs"), F.coalesce(F.max("told"), F.min("began")).alias("updated_at"))
    first = F.array(*[F.lit(float(min(1.0, max(0.0, start[k])))) for k in names])
    moved = F.aggregate("runs", first, lambda acc, r: F.transform(acc, lambda v, i: F.least(F.get(r["high"], i), F.greatest(F.get(r["low"], i), v + F.get(r["step"], i)))))
    return listed.select("profile_id", moved.alias("v"), "updated_at").select("profile_id", *[F.get("v", F.lit(i)).alias(k) for i, k in enumerate(names)], "updated_at")


def state_blocks(states: DataFrame) -> DataFrame:
    """(profile_id, session_id, block): the text put before a reply, of rows with the nine traits, valence, arousal,
    session_defensiveness, mood_label and reply_guidance. The larger of both values of defensiveness is shown."""
    shown = {k: F.round(F.col(k), 3) for k in (*PERSONALITY, *AFFECT, *RELATIONSHIP)}
    shown["defensiveness"] = F.round(F.greatest("defensiveness", "session_defensiveness"), 3)
    part = lambda names: [F.format_string(f"{k}=%.3f", clamp(shown[k], 0.0, 1.0)) for k in names]
    mood = F.concat(F.lit("mood_label="), F.coalesce("mood_label", F.lit("warm_neutral")))
    guidance = F.when(F.col("reply_guidance") != "", F.col("reply_guidance")).otherwise(STEADY)
    lines = [
        F.lit("Current Inner State"), F.concat(F.lit("Personality: "), F.concat_ws(", ", *part(PERSONALITY))), F.concat(F.lit("Affect: "), F.concat_ws(", ", *part(AFFECT), mood)),
        F.concat(F.lit("Relationship: "), F.concat_ws(", ", *part(RELATIONSHIP))), F.concat(F.lit("Reply Guidance: "), guidance),
    ]
    return states.select("profile_id", "session_id", F.concat_ws("\n", *lines).alias("block"))
