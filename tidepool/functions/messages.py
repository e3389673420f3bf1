"""Chat payloads as variants: texts, tool-call signatures, injected messages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from tidepool.functions.answers import get, kind_of
from tidepool.functions.text import token_estimate
from tidepool.operators.packing import trim

#: The text around injected memory.
GUIDE = "Use the following private memory only when it fits naturally. Keep the reply seamless and do not mention memory lookup, search, or hidden context."
NOTHING = "(none)"


def message_text(content: Column) -> Column:
    """Text of a message's content: itself, or the text parts of a list joined by line ends."""
    parts = F.filter(get(content, "$", "array<variant>"), lambda p: get(p, "$.type").isin("text", "input_text"))
    texts = F.transform(parts, lambda p: F.coalesce(F.nullif(get(p, "$.text"), F.lit("")), F.nullif(get(p, "$.input_text"), F.lit(""))))
    return F.when(kind_of(content) == "STRING", get(content, "$")).when(kind_of(content) == "ARRAY", F.array_join(texts, "\n")).otherwise("")


def normal_arguments(raw: str | None) -> str:
    """Canonical JSON of tool arguments, so that spacing and key order don't count; other text with single spaces."""
    if raw is None or not raw.strip():
        return ""
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return " ".join(raw.split())


@pandas_udf(StringType())
def normal_arguments_udf(raw: pd.Series) -> pd.Series:
    return raw.map(normal_arguments)


def signature(calls: Column) -> Column:
    """What a list of tool calls (id, name, normal_arguments) asks for, by position; by id only for calls without a name."""
    named = lambda x, i: F.concat(F.lit("idx:"), i.cast("string"), F.lit(":"), x["name"], F.lit(":"), F.coalesce(x["normal_arguments"], F.lit("")))
    each = F.transform(calls, lambda x, i: F.when(F.coalesce(x["name"], F.lit("")) != "", named(x, i)).otherwise(F.concat(F.lit("id:"), F.nullif(x["id"], F.lit("")))))
    return F.filter(each, lambda x: x.isNotNull())


def injected(persona: Column, core: Column, recent: Column, recalled: Column, budget: int) -> Column:
    """The system message that carries memory: five sections, trimmed to the budget."""
    or_nothing = lambda x: F.when(F.coalesce(x, F.lit("")) == "", NOTHING).otherwise(x)
    lines = [F.lit(GUIDE), F.lit(""), F.coalesce(persona, F.lit(""))]
    for title, body in (("Core Memory", core), ("Recent Context", recent), ("Recalled Memory", recalled)):
        lines += [F.lit(""), F.lit(title), or_nothing(body)]
    whole = F.regexp_replace(F.concat_ws("\n", *lines), r"^\s+|\s+$", "")
    return F.when(token_estimate(whole) > budget, trim(whole, F.lit(budget))).otherwise(whole)


def insert_message(messages: Column, message: Column) -> Column:
    """``messages`` with one more behind a leading system message, else in front."""
    leads = F.coalesce(F.try_element_at(messages, F.lit(1))["role"] == "system", F.lit(False))
    return F.when(leads, F.concat(F.slice(messages, 1, 1), F.array(message), F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))))).otherwise(F.concat(F.array(message), messages))


def described(messages: Column) -> Column:
    """For each message (role, text, reasoning, calls): position, role, and what it holds."""
    label = lambda c, i: F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("idx:"), i.cast("string"), F.coalesce(F.concat(F.lit(":"), F.nullif(c["name"], F.lit(""))), F.lit(""))))
    return F.transform(
        messages,
        lambda m, i: F.struct(
            i.alias("idx"), F.coalesce(m["role"], F.lit("")).alias("role"), (F.trim(F.coalesce(m["text"], F.lit(""))) != "").alias("has_text"), (F.coalesce(m["reasoning"], F.lit("")) != "").alias("has_reasoning"), F.transform(m["calls"], label).alias("calls")
        ),
    )


def model_list(models: Column, default: Column) -> Column:
    """Model names without blanks and repeats, the default in front if it isn't among them."""
    clean = F.array_distinct(F.filter(F.transform(models, lambda m: F.trim(m)), lambda m: m != ""))
    return F.when(F.coalesce(default, F.lit("")).isin("") | F.array_contains(clean, default), clean).otherwise(F.concat(F.array(default), clean))
