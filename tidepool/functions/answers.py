"""Checks of what a model answers: JSON in, typed and bounded values out, defaults where it breaks the contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.config import PersonaSettings
from tidepool.functions.scoring import clamp, limited

#: Names and defaults of the contract.
NO_DOMAIN = "未分类"
NO_NAME = "未命名"
NOT_IN_NAMES = r'[<>:"/\\|?*\n\r]'
PERSONALITY = ("openness", "conscientiousness", "extraversion", "agreeableness", "neuroticism")
RELATIONSHIP = ("affinity", "dominance", "defensiveness", "trust")
AFFECT = ("valence", "arousal")


def unfenced(raw: Column) -> Column:
    """The answer without a code fence around it."""
    bare = F.regexp_replace(raw, r"^\s+|\s+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"(?s)```(?!.*```).*$", "")).otherwise(bare)


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row: used in branches, it would else be computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def kind_of(v: Column) -> Column:
    return F.regexp_extract(F.coalesce(F.schema_of_variant(v), F.lit("")), "^[A-Z]*", 0)


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _words(v: Column, path: str, most: int, default: Column) -> Column:
    return F.slice(F.coalesce(get(v, path, "array<string>"), default), 1, most)


def _mood(v: Column) -> tuple[Column, Column]:
    """Valence and arousal in bounds; both fall back if either is no number."""
    valence, arousal = (F.coalesce(get(v, p), F.lit(str(d))).try_cast("double") for p, d in (("$.valence", 0.5), ("$.arousal", 0.3)))
    good = valence.isNotNull() & arousal.isNotNull()
    return F.when(good, clamp(valence, 0, 1)).otherwise(0.5), F.when(good, clamp(arousal, 0, 1)).otherwise(0.3)


def analysis(raw: Column, most_tags: int = 15) -> Column:
    """Struct (domain, valence, arousal, tags, suggested_name) of a tagging answer."""
    v = parsed(unfenced(raw))
    good = kind_of(v) == "OBJECT"
    valence, arousal = _mood(v)
    none = F.array().cast("array<string>")
    own = F.array(F.lit(NO_DOMAIN))
    return F.struct(
        F.when(good, _words(v, "$.domain", 3, own)).otherwise(own).alias("domain"), F.when(good, valence).otherwise(0.5).alias("valence"), F.when(good, arousal).otherwise(0.3).alias("arousal"),
        F.when(good, _words(v, "$.tags", most_tags, none)).otherwise(none).alias("tags"), F.when(good, F.left(F.coalesce(get(v, "$.suggested_name"), F.lit("")), F.lit(20))).otherwise("").alias("suggested_name"),
    )


def retagging(raw: Column, name: Column) -> Column:
    """Struct (domain, tags, name, valence, arousal) of an answer that tags a memory anew: at most five tags, the old name where none is suggested, without signs that files can't have and cut to 20.

    Null, which leaves a memory as it is, if the answer is no JSON object or a mood in it is no number.
    """
    v = parsed(unfenced(raw))
    mood = {p: F.coalesce(get(v, f"$.{p}"), F.lit(d)).try_cast("double") for p, d in (("valence", "0.5"), ("arousal", "0.3"))}
    suggested = F.coalesce(get(v, "$.suggested_name"), F.lit(""))
    named = F.regexp_replace(F.when(suggested != "", suggested).otherwise(F.coalesce(name, F.lit(""))), NOT_IN_NAMES, "")
    short = F.left(F.regexp_replace(named, r"^\s+|\s+$", ""), F.lit(20))
    out = F.struct(
        _words(v, "$.domain", 3, F.array(F.lit(NO_DOMAIN))).alias("domain"), _words(v, "$.tags", 5, F.array().cast("array<string>")).alias("tags"),
        F.when(short != "", short).otherwise(NO_NAME).alias("name"), *[clamp(x, 0, 1).alias(p) for p, x in mood.items()],
    )
    return F.when((kind_of(v) == "OBJECT") & mood["valence"].isNotNull() & mood["arousal"].isNotNull(), out)


def items(raw: Column, most_tags: int = 15) -> Column:
    """Array of structs of a splitting answer; items without content are dropped, anything but a list gives none."""
    v = parsed(unfenced(raw))

    def item(x: Column) -> Column:
        valence, arousal = _mood(x)
        importance = F.coalesce(F.coalesce(get(x, "$.importance"), F.lit("5")).try_cast("double").cast("int"), F.lit(5))
        return F.struct(
            F.left(F.coalesce(get(x, "$.name"), F.lit("")), F.lit(20)).alias("name"), get(x, "$.content").alias("content"), _words(x, "$.domain", 3, F.array(F.lit(NO_DOMAIN))).alias("domain"), valence.alias("valence"), arousal.alias("arousal"),
            _words(x, "$.tags", most_tags, F.array().cast("array<string>")).alias("tags"), clamp(importance.cast("double"), 1, 10).cast("int").alias("importance"),
        )

    listed = F.when(kind_of(v) == "ARRAY", get(v, "$", "array<variant>"))
    full = F.filter(listed, lambda x: (kind_of(x) == "OBJECT") & (F.coalesce(get(x, "$.content"), F.lit("")) != ""))
    return F.coalesce(F.transform(full, item), F.array())


def evaluation(raw: Column, s: PersonaSettings = PersonaSettings()) -> Column:
    """Struct of a mood evaluation: labels cut to length, deltas limited; null if there is no JSON object in the answer."""
    inner = F.regexp_extract(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(json)?\s*", ""), r"\s*```$", ""), r"(?s)\{.*\}", 0)
    groups = {"affect_delta": (AFFECT, s.affect_limit), "relationship_delta": (RELATIONSHIP, s.relationship_limit), "personality_delta": (PERSONALITY, s.personality_limit)}
    labels = {"event_type": (40, "neutral"), "perceived_intent": (200, ""), "mood_label": (60, "warm_neutral"), "reply_guidance": (240, "")}
    told = ", ".join([f"{x} string" for x in (*labels, "confidence")] + [f"{g} struct<{', '.join(f'{n} string' for n in names)}>" for g, (names, _) in groups.items()])

    def out(v: Column) -> Column:
        words = lambda x: F.left(F.coalesce(v[x], F.lit(labels[x][1])), F.lit(labels[x][0])).alias(x)
        # An absent delta is 0, a broken one the lower bound.
        deltas = lambda g: F.struct(*[limited(F.coalesce(v[g][n], F.lit("0")), groups[g][1]).alias(n) for n in groups[g][0]]).alias(g)
        confidence = clamp(F.coalesce(F.coalesce(v["confidence"], F.lit("0.5")).try_cast("double"), F.lit(0.0)), 0, 1).alias("confidence")
        return F.when(v.isNotNull(), F.struct(words("event_type"), words("perceived_intent"), *map(deltas, groups), words("mood_label"), words("reply_guidance"), confidence))

    # One read of the whole object, which is null for anything else; fields of another kind are null in it, as by paths.
    return once(get(parsed(inner), "$", f"struct<{told}>"), out)
