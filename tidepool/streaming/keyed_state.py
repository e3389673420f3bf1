"""Profile state by transformWithState: ordered by event time, and kept no longer than it is needed.

It needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass (see ``ROCKSDB``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidepool.functions.answers import PERSONALITY, RELATIONSHIP
from tidepool.operators.persona import START

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TRAITS = [*PERSONALITY, *RELATIONSHIP]
_TRAIT_SCHEMA = ", ".join(f"{k} double" for k in TRAITS)
PROFILE_SCHEMA = f"profile_id string, at timestamp, event_id long, {_TRAIT_SCHEMA}"


class _Profile(StatefulProcessor):
    """Nine traits of a profile, and the events that the watermark hasn't passed yet."""

    def __init__(self, start: dict[str, float]):
        self.start = [float(min(1.0, max(0.0, start[k]))) for k in TRAITS]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.traits = handle.getValueState("traits", _TRAIT_SCHEMA)
        self.waiting = handle.getListState("waiting", "at long, event_id long, " + _TRAIT_SCHEMA)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(r.at.value // 1000), int(r.event_id), *(float(getattr(r, k)) for k in TRAITS)) for frame in rows for r in frame.itertuples(index=False)]
        self.waiting.appendList(new)
        self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)  # milliseconds: once all of these are past
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in rows if r[0] < past]
        held = list(self.traits.get()) if self.traits.exists() else self.start
        out = []
        for at, event_id, *step in ready:
            held = [min(1.0, max(0.0, v + d)) for v, d in zip(held, step, strict=True)]
            out.append((key[0], pd.Timestamp(at, unit="us"), event_id, *held))
        if ready:
            if len(ready) < len(rows):
                self.waiting.put(rows[len(ready) :])
            else:
                self.waiting.clear()
        if out:
            self.traits.update(tuple(held))
            yield pd.DataFrame(out, columns=["profile_id", "at", "event_id", *TRAITS])

    def close(self) -> None:
        pass


def streamed_profiles(log: DataFrame, late: str = "1 hour", start: dict[str, float] = START) -> DataFrame:
    """(profile_id, at, event_id, the nine traits) after each event of a stream of ``event_log``, in the order of (ts, event_id).

    An event waits in the state until the watermark, ``late`` behind the newest event, has passed it; a timer lets it
    move the profile then, so that it doesn't matter in which micro-batches events come. Later ones are dropped. The last row
    of a profile holds what ``operators.persona.profiles`` makes of the same events.
    """
    deltas = [F.coalesce(F.col(f"personality_delta.{k}"), F.lit(0.0)).alias(k) for k in PERSONALITY] + [F.coalesce(F.col(f"relationship_delta.{k}"), F.lit(0.0)).alias(k) for k in RELATIONSHIP]
    steps = log.select(F.col("profile_id").cast("string").alias("profile_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").cast("long").alias("event_id"), *deltas)
    return steps.withWatermark("at", late).groupBy("profile_id").transformWithStateInPandas(_Profile(start), PROFILE_SCHEMA, "append", "EventTime")
