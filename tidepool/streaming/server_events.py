"""Streamed chat answers: byte chunks of server-sent events as rows, aggregated into whole messages with built-ins only.

A stream's chunks are joined, cut into events, and every choice of an event gives up to two pieces: a ``delta``,
which adds to what was said, and a ``message``, which takes its place. Events that can't be read say nothing.
On a stream ``streamed_events`` cuts the events, with what is unfinished kept as state, and ``messages_of_events``
makes messages of what it wrote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TEXTS = ("content", "reasoning_content")
_CALL = "struct<index:int,id:string,type:string,function:struct<name:string,arguments:string>>"


_BREAK = re.compile(rb"(?:\r\n|\n){2}")


def _parsed(rows: DataFrame) -> DataFrame:
    """(stream_id, at, v): the parsed data of each event (stream_id, at, event)."""
    lines = F.filter(F.transform(F.split("event", "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("data:")))
    data = F.array_join(F.transform(lines, lambda x: F.trim(F.substring(x, 6, 1 << 30))), "\n")
    return rows.select("stream_id", "at", F.try_parse_json(data).alias("v"))


def _events(chunks: DataFrame) -> DataFrame:
    """The parsed events of whole streams, whatever the cuts between chunks."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    whole = F.make_valid_utf8(F.aggregate(ordered, F.lit(b""), lambda raw, x: F.concat(raw, x["chunk"])).cast("string"))
    events = chunks.groupBy("stream_id").agg(F.replace(whole, F.lit("\r\n"), F.lit("\n")).alias("text"))
    return _parsed(events.select("stream_id", F.posexplode(F.split("text", "\n\n")).alias("at", "event")))


def streamed_events(chunks: DataFrame, idle_minutes: float = 10, first: int = 0) -> DataFrame:
    """(stream_id, at, event) of a stream of (stream_id, seq, chunk): each event's bytes as soon as the blank line after it has come.

    ``seq`` counts a stream's chunks from ``first``; chunks that come early wait for those before them, and one that
    comes again is not taken twice. State is a stream's unfinished bytes, with line ends and characters cut anywhere.
    Once nothing came for ``idle_minutes``, what waits is taken as it is, lost chunks left out, and the rest is the last
    event. A stream may go on behind that; it is forgotten when as much time has passed again.
    """
    wait = max(1, int(idle_minutes * 60_000))
    schema = f"stream_id {chunks.schema['stream_id'].dataType.simpleString()}, at long, event binary"

    def cut(key: tuple, at: int, raw: bytes, last: bool) -> tuple[pd.DataFrame, int, bytes]:
        parts, begin = [], 0
        for m in _BREAK.finditer(raw):
            parts.append(raw[begin : m.start()])
            begin = m.end()
        rest = raw[begin:]
        if last and rest:
            parts, rest = [*parts, rest], b""
        rows = [(key[0], at + i, p.replace(b"\r\n", b"\n")) for i, p in enumerate(parts) if p]
        return pd.DataFrame(rows, columns=["stream_id", "at", "event"]), at + len(parts), rest

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        want, at, raw, seqs, waiting = state.get if state.exists else (first, 0, b"", [], [])
        early = {int(s): bytes(c) for s, c in zip(seqs, waiting, strict=True)}
        if state.hasTimedOut:
            rows, at, _ = cut(key, at, b"".join([bytes(raw), *(early[s] for s in sorted(early))]), True)
            if raw or early:
                state.update((max([want - 1, *early]) + 1, at, b"", [], []))
                state.setTimeoutDuration(wait)
            else:
                state.remove()
            yield rows
            return
        for frame in frames:
            for s, c in zip(frame.seq, frame.chunk, strict=True):
                if s >= want:
                    early[int(s)] = bytes(c) if c is not None else b""
        pieces = [bytes(raw)]
        while want in early:
            pieces.append(early.pop(want))
            want += 1
        rows, at, rest = cut(key, at, b"".join(pieces), False)
        state.update((want, at, rest, list(early), list(early.values())))
        state.setTimeoutDuration(wait)
        yield rows

    kept = "want long, at long, raw binary, seqs array<long>, waiting array<binary>"
    return chunks.select("stream_id", "seq", "chunk").groupBy("stream_id").applyInPandasWithState(run, schema, kept, "append", GroupStateTimeout.ProcessingTimeTimeout)


def messages_of_events(events: DataFrame) -> DataFrame:
    """What ``messages_of`` gives, from the events that ``streamed_events`` wrote."""
    return _messages(_parsed(events.select("stream_id", "at", F.make_valid_utf8(F.col("event").cast("string")).alias("event"))))


def _pieces(events: DataFrame) -> DataFrame:
    """(stream_id, at, whole, role, content, reasoning_content, calls): what each choice says; ``at`` is its place in the stream."""
    choices = events.select("stream_id", "at", F.posexplode(F.try_variant_get("v", "$.choices", "array<variant>")).alias("choice", "c"))
    both = F.array(*(F.struct(F.lit(i).alias("whole"), F.try_variant_get("c", f"$.{k}", "variant").alias("p")) for i, k in enumerate(("delta", "message"))))
    rows = choices.select("stream_id", "at", "choice", F.explode(both).alias("x")).where("x.p IS NOT NULL AND schema_of_variant(x.p) LIKE 'OBJECT%'")
    texts = (F.when(F.schema_of_variant(F.try_variant_get("x.p", f"$.{k}", "variant")) == "STRING", F.try_variant_get("x.p", f"$.{k}", "string")).alias(k) for k in TEXTS)
    return rows.select("stream_id", F.struct("at", "choice", "x.whole").alias("at"), (F.col("x.whole") == 1).alias("whole"), F.try_variant_get("x.p", "$.role", "string").alias("role"), *texts, F.try_variant_get("x.p", "$.tool_calls", f"array<{_CALL}>").alias("calls"))


def _since_replaced(pieces: DataFrame, column: str) -> DataFrame:
    """The pieces that say something in ``column``, from the last one on that takes the place of what was said."""
    said = pieces.where(F.col(column).isNotNull())
    last = F.max(F.when(F.col("whole"), F.col("at"))).over(Window.partitionBy("stream_id"))
    return said.withColumn("last", last).where("last IS NULL OR at >= last").drop("last")


def _in_order(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("at", value.alias("x")))), lambda y: y["x"])


def _latest(column: str) -> Column:
    """The last value that isn't empty."""
    given = F.when(F.col(column) != "", F.col(column))
    return F.max_by(given, F.when(given.isNotNull(), F.col("at")))


def messages_of(chunks: DataFrame) -> DataFrame:
    """(stream_id, role, content, reasoning, tool_calls) of each stream of (stream_id, seq, chunk); streams that said nothing give none.

    Pieces of one tool call meet by their index: names and arguments are joined in order, of ids and kinds the last counts.
    """
    return _messages(_events(chunks))


def _messages(events: DataFrame) -> DataFrame:
    pieces = _pieces(events)
    out = pieces.groupBy("stream_id").agg(F.coalesce(_latest("role"), F.lit("assistant")).alias("role"))
    for c in TEXTS:
        joined = _since_replaced(pieces, c).groupBy("stream_id").agg(F.array_join(_in_order(F.col(c)), "").alias(c))
        out = out.join(joined, "stream_id", "left")
    calls = _since_replaced(pieces, "calls").select("stream_id", "at", "whole", F.posexplode("calls").alias("place", "c")).where("c IS NOT NULL")
    calls = calls.select("stream_id", F.struct("at", "place").alias("at"), F.when(F.col("whole"), F.col("place")).otherwise(F.coalesce("c.index", F.lit(0))).alias("index"), "c.id", "c.type", "c.function.name", "c.function.arguments")
    text = lambda c: F.array_join(_in_order(F.coalesce(c, F.lit(""))), "")
    merged = calls.groupBy("stream_id", "index").agg(_latest("id").alias("id"), F.coalesce(_latest("type"), F.lit("function")).alias("type"), F.struct(text("name").alias("name"), text("arguments").alias("arguments")).alias("function"))
    listed = merged.groupBy("stream_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "id", "type", "function"))), lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["function"].alias("function"))).alias("listed"))
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    whole = out.join(listed, "stream_id", "left").select("stream_id", "role", none("content").alias("content"), none("reasoning_content").alias("reasoning"), F.coalesce(F.to_json("listed"), F.lit("[]")).alias("tool_calls"))
    return whole.where("content IS NOT NULL OR reasoning IS NOT NULL OR tool_calls <> '[]'")
