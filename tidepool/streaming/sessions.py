"""Session state on streams: rounds, moods, cached reasoning. Each has a batch form with the same results."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidepool.config import PersonaSettings

#: Where a session's mood rests.
REST = {"valence": 0.56, "arousal": 0.34, "defensiveness": 0.12}
ROUND_SCHEMA = "session_id long, round_id long, bucket_id long, completed_at timestamp_ntz"
MOOD_SCHEMA = "session_id long, event_id long, valence double, arousal double, defensiveness double"


def numbered_rounds(events: DataFrame) -> DataFrame:
    """(session_id, round_id, bucket_id, completed_at) of a stream (session_id, bucket_id, completed_at, event_id): a counter a session.

    Within a micro-batch rounds follow (completed_at, event_id); over batches they follow arrival.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values(["completed_at", "event_id"])
        last = state.get[0] if state.exists else 0
        state.update((last + len(frame),))
        yield pd.DataFrame({"session_id": key[0], "round_id": range(last + 1, last + 1 + len(frame)), "bucket_id": frame.bucket_id.to_numpy(), "completed_at": frame.completed_at.to_numpy()})

    return events.groupBy("session_id").applyInPandasWithState(run, ROUND_SCHEMA, "last long", "append", GroupStateTimeout.NoTimeout)


def mood_step(mood: dict, minutes: float, delta: dict, s: PersonaSettings) -> dict:
    """One message: the mood drifts back to rest for the time since the last one, then takes a limited change."""
    limits = {"valence": s.affect_limit, "arousal": s.affect_limit, "defensiveness": s.relationship_limit}
    out = {}
    for k, rest in REST.items():
        value = mood[k]
        if minutes > 0 and s.half_life_minutes > 0:
            value = rest + (value - rest) * 0.5 ** (minutes / s.half_life_minutes)
        change = delta.get(k, 0.0)
        change = -limits[k] if change is None or change != change else min(limits[k], max(-limits[k], change))
        out[k] = min(1.0, max(0.0, value + change))
    return out


def _fold(frame: pd.DataFrame, mood: dict, at, s: PersonaSettings) -> tuple[list[tuple], dict, object]:
    rows = []
    for r in frame.sort_values(["ts", "event_id"]).itertuples(index=False):
        minutes = 0.0 if at is None else (r.ts - at).total_seconds() / 60
        mood = mood_step(mood, minutes, {"valence": r.d_valence, "arousal": r.d_arousal, "defensiveness": r.d_defensiveness}, s)
        at = r.ts
        rows.append((r.session_id, r.event_id, *(round(mood[k], 4) for k in REST)))
    return rows, mood, at


_COLUMNS = ["session_id", "event_id", *REST]


def moods(events: DataFrame, s: PersonaSettings = PersonaSettings()) -> DataFrame:
    """The mood after each message of (session_id, event_id, ts, d_valence, d_arousal, d_defensiveness); sessions run in parallel."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_fold(frame, dict(REST), None, s)[0], columns=_COLUMNS)

    return events.groupBy("session_id").applyInPandas(run, MOOD_SCHEMA)


def last_moods(events: DataFrame, s: PersonaSettings = PersonaSettings()) -> DataFrame:
    """(session_id, valence, arousal, session_defensiveness) after each session's last message, and ``mood_label``, the last
    that isn't null, if ``events`` has it. Sessions stream through their tasks in order, so that none is held whole."""
    labelled = "mood_label" in events.columns
    columns = ["session_id", "event_id", "ts", "d_valence", "d_arousal", "d_defensiveness", *["mood_label"] * labelled]
    told = "session_id long, valence double, arousal double, session_defensiveness double" + ", mood_label string" * labelled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, mood, at, label, some = None, dict(REST), None, None, False
        for batch in batches:
            out = []
            labels = batch.column(5).to_pylist() if labelled else [None] * len(batch)
            for session, ts, valence, arousal, defensiveness, said in zip(*(batch.column(i).to_pylist() for i in range(5)), labels, strict=True):
                if not some or session != who:
                    if some:
                        out.append((who, *mood.values(), *[label] * labelled))
                    who, mood, at, label, some = session, dict(REST), None, None, True
                minutes = 0.0 if at is None or ts is None else (ts - at) / 60_000_000
                mood = mood_step(mood, minutes, {"valence": valence, "arousal": arousal, "defensiveness": defensiveness}, s)
                at, label = ts, label if said is None else said
            yield _batch(out, told)
        if some:
            yield _batch([(who, *mood.values(), *[label] * labelled)], told)

    # Nulls come last, as in the other forms. Sorted by session, each task has its sessions one after another.
    micros = F.unix_micros(F.col("ts").cast("timestamp")) if dict(events.dtypes)["ts"] == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    dealt = events.select(*columns).withColumn("ts", micros).repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    return dealt.drop("event_id").mapInArrow(run, told)


def _batch(rows: list[tuple], told: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    fields = [x.split() for x in told.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def streamed_moods(events: DataFrame, s: PersonaSettings = PersonaSettings()) -> DataFrame:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mood, at = dict(REST), None
        if state.exists:
            *values, last = state.get
            mood, at = dict(zip(REST, values, strict=True)), pd.Timestamp(last)
        rows, mood, at = _fold(pd.concat(list(frames)), mood, at, s)
        state.update((*(mood[k] for k in REST), str(at)))
        yield pd.DataFrame(rows, columns=_COLUMNS)

    return events.groupBy("session_id").applyInPandasWithState(run, MOOD_SCHEMA, "valence double, arousal double, defensiveness double, at string", "append", GroupStateTimeout.NoTimeout)


def cached_reasoning(messages: DataFrame, keep_minutes: float = 60) -> DataFrame:
    """Reasoning restored to assistant messages of (session_id, seq, signature, reasoning): a message with tool calls but
    no reasoning gets that of the last one with the same signature; a reply without tool calls clears the session.

    State is one map a session. Each signature is forgotten ``keep_minutes`` after it was stored, however busy its session
    is; the map is dropped after ``keep_minutes`` without a message.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now, kept = time.time(), json.loads(state.get[0]) if state.exists else {}
        kept = {name: held for name, held in kept.items() if now - held[1] < keep_minutes * 60}
        out = []
        for r in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
            name = "\n".join(r.signature) if r.signature is not None and len(r.signature) else ""
            reasoning = r.reasoning or (kept[name][0] if name in kept else None)
            if not name:
                kept = {}
            elif r.reasoning:
                kept[name] = [r.reasoning, now]
            out.append((r.session_id, r.seq, reasoning))
        state.update((json.dumps(kept),))
        state.setTimeoutDuration(max(1, int(keep_minutes * 60_000)))
        yield pd.DataFrame(out, columns=["session_id", "seq", "reasoning"])

    return messages.groupBy("session_id").applyInPandasWithState(run, "session_id long, seq long, reasoning string", "kept string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def activation_windows(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(bucket_id, start, hits) of a stream (bucket_id, at): activations in tumbling windows, late ones up to ``late``.

    An extension: it has no counterpart among the memory tools, and feeds counts into ``operators.writes.touched``.
    """
    counted = events.withWatermark("at", late).groupBy("bucket_id", F.window("at", width)).agg(F.count("*").alias("hits"))
    return counted.select("bucket_id", F.col("window.start").alias("start"), "hits")
