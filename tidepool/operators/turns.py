"""Conversations: role switches, last messages, chunks of turns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.text import token_estimate, turn_line

#: What begins a turn in a plain-text log, in any case.
USER_PREFIXES = ("human:", "user:", "你:", "我:")
OTHER_PREFIXES = ("assistant:", "claude:", "ai:", "gpt:", "bot:", "deepseek:")


def last_messages(turns: DataFrame) -> DataFrame:
    """(conv_id, query, current_query): the last user message with text, and the last message but system ones if it is the user's."""
    said = F.trim(F.coalesce("text", F.lit(""))) != ""
    user, spoken = (F.col("role") == "user") & said, F.col("role") != "system"
    return turns.groupBy("conv_id").agg(
        F.max_by(F.when(user, F.col("text")), F.when(user, F.col("turn"))).alias("query"),
        F.max_by(F.when(spoken, F.struct("role", "text")), F.when(spoken, F.col("turn"))).alias("last"),
    ).select("conv_id", "query", F.when(F.col("last.role") == "user", F.col("last.text")).alias("current_query"))


def plain_turns(logs: DataFrame) -> DataFrame:
    """(id, turn, role, content) of plain-text ``logs`` (id, text): a line with a role prefix begins a turn, other lines continue one."""
    lines = logs.select("id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("bare", F.regexp_replace("line", r"(?U)^\s+|\s+$", ""))
    low = F.lower("bare")
    starts = lambda names: F.greatest(*[low.startswith(n) for n in names])
    role = F.when(starts(USER_PREFIXES), "user").when(starts(OTHER_PREFIXES), "assistant")
    marked = lines.withColumn("role", role)
    w = Window.partitionBy("id").orderBy("pos")
    grouped = marked.withColumn("part", F.sum(F.col("role").isNotNull().cast("int")).over(w))
    text = F.when(F.col("role").isNotNull(), F.regexp_replace(F.regexp_extract("bare", r"(?s)^[^:]*:(.*)$", 1), r"(?U)^\s+", "")).otherwise(F.col("line"))
    turns = grouped.groupBy("id", "part").agg(F.max("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda x: x["t"]), "\n").alias("content"))
    turns = turns.withColumn("content", F.regexp_replace("content", r"(?U)^\s+|\s+$", "")).where("content <> ''")
    return turns.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("part")) - 1).alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), "content")


def chunks(turns: DataFrame, target: int = 10_000) -> DataFrame:
    """(conv_id, chunk, content, first_turn, last_turn, turn_count, tokens, timestamp_start, timestamp_end): whole turns up to about ``target`` tokens.

    The start is the first time that a turn of the chunk has, the end that of its last turn; "" without one. A turn over 1.5 times the target stands alone. Whether a turn begins a chunk depends on all before it, so each
    conversation is folded in order; tokens are counted before, in the plan.
    """
    turns = turns if "timestamp" in turns.columns else turns.withColumn("timestamp", F.lit(""))
    lines = turns.withColumn("timestamp", F.coalesce("timestamp", F.lit(""))).withColumn("line", turn_line(F.col("role"), F.col("text"))).withColumn("tokens", token_estimate(F.col("line"))).select("conv_id", "turn", "line", "tokens", "timestamp")

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("turn", kind="stable")
        groups: list[list] = []
        size, fresh = 0, True
        for row in frame.itertuples(index=False):
            alone = row.tokens > 1.5 * target
            if alone or fresh or size + row.tokens > target:
                groups.append([])
                size = 0
            groups[-1].append(row)
            size += row.tokens
            fresh = alone
        return pd.DataFrame(
            [(g[0].conv_id, i, "\n".join(r.line for r in g), g[0].turn, g[-1].turn, len(g), int(sum(r.tokens for r in g)), next((r.timestamp for r in g if r.timestamp), ""), g[-1].timestamp) for i, g in enumerate(groups)],
            columns=["conv_id", "chunk", "content", "first_turn", "last_turn", "turn_count", "tokens", "timestamp_start", "timestamp_end"],
        )

    return lines.groupBy("conv_id").applyInPandas(fold, "conv_id long, chunk long, content string, first_turn long, last_turn long, turn_count long, tokens long, timestamp_start string, timestamp_end string")
