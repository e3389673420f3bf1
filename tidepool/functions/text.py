"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of the thinking mode.
THINKING_ON = ("enabled", "enable", "on", "true")
THINKING_OFF = ("disabled", "disable", "off", "false", "non-thinking", "non_thinking")

#: How turns are labelled in an import.
USER_LABEL, OTHER_LABEL = "用户", "AI"


def token_parts(text: Column) -> Column:
    """Estimated tokens before truncation: by Han characters, Latin words and length. Adds up over pieces, unlike the estimate."""
    return F.lit(1.5) * F.regexp_count(text, F.lit(r"[一-鿿]")) + F.lit(1.3) * F.regexp_count(text, F.lit("[a-zA-Z]+")) + F.lit(0.05) * F.length(text)


def token_estimate(text: Column) -> Column:
    return F.coalesce(token_parts(text).cast("int"), F.lit(0))


def without_links(text: Column) -> Column:
    """``[[x]]`` as ``x``."""
    return F.regexp_replace(text, r"\[\[([^\]]+)\]\]", "$1")


def safe_name(name: Column, most: int = 80) -> Column:
    """Word characters, spaces and dashes of a name, cut to ``most``; "unnamed" if nothing is left."""
    kept = F.regexp_replace(name, r"(?U)[^\w\s一-鿿-]", "")
    kept = F.left(F.regexp_replace(kept, r"(?U)^\s+|\s+$", ""), F.lit(most))
    return F.when(F.coalesce(kept, F.lit("")) == "", "unnamed").otherwise(kept)


def masked(key: Column) -> Column:
    """A secret as it may be shown: four letters at each end of a long one, stars for a short one, "" for none."""
    key = F.coalesce(key, F.lit(""))
    return F.when(F.length(key) > 8, F.concat(F.left(key, F.lit(4)), F.lit("..."), F.right(key, F.lit(4)))).when(key != "", "***").otherwise("")


def short_id() -> Column:
    """A new id of twelve hex digits a row."""
    return F.left(F.replace(F.uuid(), F.lit("-"), F.lit("")), F.lit(12))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def thinking_mode(value: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(value.cast("string"), F.lit(""))))
    return F.when(low.isin(*THINKING_ON), "enabled").when(low.isin(*THINKING_OFF), "disabled").otherwise("")


def turn_label(role: Column) -> Column:
    return F.when(role.isin("user", "human"), USER_LABEL).otherwise(OTHER_LABEL)


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(F.lit("["), turn_label(role), F.lit("] "), text)


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", F.round(x, 1))


def summary_header(name: Column, domain: Column, valence: Column, arousal: Column, model_valence: Column, digested: Column) -> Column:
    """The line that introduces a memory: name, domains, mood, the model's own view, whether it was digested."""
    joined = F.array_join(domain, ", ")
    return F.concat(
        F.lit("📌 记忆桶: "), F.coalesce(name, F.lit("未命名")),
        F.when(F.coalesce(joined, F.lit("")) != "", F.concat(F.lit(" [主题:"), joined, F.lit("]"))).otherwise(""),
        F.lit(" [情感:V"), one_decimal(F.coalesce(valence, F.lit(0.5))), F.lit("/A"), one_decimal(F.coalesce(arousal, F.lit(0.3))), F.lit("]"),
        F.when(model_valence.isNotNull(), F.concat(F.lit(" [我的视角:V"), one_decimal(model_valence), F.lit("]"))).otherwise(""),
        F.when(F.coalesce(digested, F.lit(False)), " [已消化]").otherwise(""),
        F.lit("\n"),
    )


def status_icon(kind: Column, resolved: Column, pinned: Column, protected: Column) -> Column:
    return (
        F.when(F.coalesce(pinned, F.lit(False)) | F.coalesce(protected, F.lit(False)), "📌")
        .when(kind == "permanent", "📦").when(kind == "feel", "🫧").when(kind == "archived", "🗄️")
        .when(F.coalesce(resolved, F.lit(False)), "✅").otherwise("💭")
    )
