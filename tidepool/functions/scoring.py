"""Scores as column expressions. The clock is always an argument; nothing here reads the current time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.config import DecaySettings, PersonaSettings, RecallSettings, SearchSettings

#: Fixed values of the scores.
PINNED_SCORE, FEEL_SCORE = 999.0, 50.0
DEFAULT_DAYS, UNKNOWN_DAYS = 30.0, 999.0
EMOTION_SPAN = 1.414
FRESH_HOURS = 36.0


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` held between the bounds. Null stays null: least and greatest would otherwise skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def number(x: Column, default: float) -> Column:
    """A number, or the default where there is none."""
    return F.coalesce(x.try_cast("double"), F.lit(default))


def scaled_round(x: Column, places: int) -> Column:
    """``x`` times ten to ``places``, rounded to a whole number and scaled back, as SQL engines round doubles: 0.5075 is just
    under the tie and becomes 0.507 at three places, where rounding its decimal form gives 0.508."""
    return F.round(x * F.lit(10.0**places), 0) / F.lit(10.0**places)


def flag(x: Column) -> Column:
    """A flag that is false where it was never set."""
    return F.coalesce(x, F.lit(False))


def parsed_time(text: Column) -> Column:
    """A naive ISO timestamp; null for anything with an offset or in another shape."""
    plain = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$")
    return F.when(plain, F.try_to_timestamp(text)).try_cast("timestamp_ntz")


def days_between(then: Column, now: Column, default: float = DEFAULT_DAYS) -> Column:
    """Days from ``then`` to ``now``, at least 0; the default where ``then`` is unknown."""
    days = F.timestamp_diff("MICROSECOND", then, now).cast("double") / F.lit(86_400e6)
    return F.when(days.isNull(), F.lit(default)).otherwise(F.greatest(F.lit(0.0), days))


def freshness(days: Column) -> Column:
    """2 for what was touched just now, near 1 after a few days."""
    return F.lit(1.0) + F.exp(-days * F.lit(24.0) / F.lit(FRESH_HOURS))


def decay_score(kind: Column, importance: Column, activations: Column, days: Column, arousal: Column, resolved: Column, digested: Column, pinned: Column, protected: Column, s: DecaySettings = DecaySettings()) -> Column:
    """How alive a memory is. Pinned and permanent ones don't fade, feelings hold a constant score."""
    weight = clamp(F.coalesce(importance.try_cast("int"), F.lit(5)).cast("double"), 1.0, 10.0)
    uses = F.greatest(F.lit(1), F.coalesce(activations.cast("int"), F.lit(1))).cast("double")
    feeling = clamp(number(arousal, 0.3), 0.0, 1.0)
    emotion = F.lit(s.emotion_base) + feeling * F.lit(s.arousal_boost)
    fresh = freshness(days)
    blend = F.when(days <= 3.0, F.lit(0.7) * fresh + F.lit(0.3) * emotion).otherwise(F.lit(0.7) * emotion + F.lit(0.3) * fresh)
    settled = F.when(flag(resolved) & flag(digested), 0.02).when(flag(resolved), 0.05).otherwise(1.0)
    urgent = F.when((feeling > 0.7) & ~flag(resolved), 1.5).otherwise(1.0)
    alive = F.round(weight * F.pow(uses, F.lit(0.3)) * F.exp(F.lit(-s.rate) * days) * blend * settled * urgent, 4)
    return F.when(flag(pinned) | flag(protected) | kind.eqNullSafe("permanent"), PINNED_SCORE).when(kind.eqNullSafe("feel"), FEEL_SCORE).otherwise(alive)


def emotion_match(asked_valence: Column, asked_arousal: Column, valence: Column, arousal: Column) -> Column:
    """1 for the asked mood, falling with the distance; 0.5 where no mood was asked for."""
    gap = F.sqrt(F.pow(asked_valence - number(valence, 0.5), 2) + F.pow(asked_arousal - number(arousal, 0.3), 2))
    return F.when(asked_valence.isNull() | asked_arousal.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap / F.lit(EMOTION_SPAN)))


def time_proximity(days: Column) -> Column:
    return F.exp(F.lit(-0.1) * days)


def importance_share(importance: Column) -> Column:
    return clamp(F.coalesce(importance.try_cast("int"), F.lit(5)).cast("double"), 1.0, 10.0) / F.lit(10.0)


def search_score(topic: Column, emotion: Column, time: Column, importance: Column, resolved: Column, s: SearchSettings = SearchSettings()) -> Column:
    """Weighted relevance on a scale of 100, not yet rounded. The weights' sum leaves out the one of the content."""
    total = topic * s.topic + emotion * s.emotion + time * s.time + importance * s.importance
    scaled = total / F.lit(s.topic + s.emotion + s.time + s.importance) * 100.0
    return F.when(flag(resolved), scaled * 0.3).otherwise(scaled)


def cooldown(hours: Column, s: RecallSettings = RecallSettings()) -> Column:
    """What is left of a score ``hours`` after the memory was last injected; 1 if it never was."""
    grown = F.round(F.lit(s.cooldown_floor) + F.lit(1 - s.cooldown_floor) * F.greatest(F.lit(0.0), hours) / F.lit(s.cooldown_hours), 4)
    if s.cooldown_hours <= 0:
        return F.lit(1.0)
    return F.when(hours.isNull() | (hours >= s.cooldown_hours), 1.0).otherwise(grown)


def recall_score(semantic: Column, keyword: Column, importance: Column, days: Column, cooled: Column, s: RecallSettings = RecallSettings()) -> Column:
    mixed = clamp(semantic, 0.0, 1.0) * s.semantic + clamp(keyword, 0.0, 1.0) * s.keyword + clamp(number(importance, 5.0) / 10.0, 0.0, 1.0) * s.importance + clamp(time_proximity(days), 0.0, 1.0) * s.freshness
    return F.round(mixed * cooled, 4)


def mood_shift(valence: Column, asked: Column) -> Column:
    """A memory's valence as coloured by the asker's mood; unchanged where none was given."""
    return F.when(asked.isNull(), valence).otherwise(clamp(valence + (asked - F.lit(0.5)) * F.lit(0.2), 0.0, 1.0))


def merged_average(old: Column, new: Column) -> Column:
    return F.round((old + new) / 2, 2)


def mood_decay(value: Column, rest: Column, minutes: Column, s: PersonaSettings = PersonaSettings()) -> Column:
    """A session's mood on its way back to rest."""
    if s.half_life_minutes <= 0:
        return value
    left = rest + (value - rest) * F.pow(F.lit(0.5), minutes / F.lit(s.half_life_minutes))
    return F.when(minutes <= 0, value).otherwise(clamp(left, 0.0, 1.0))


def limited(delta: Column, most: float) -> Column:
    """A change held within +-most; what is no number becomes the lower bound."""
    least = F.lit(-most)
    return F.greatest(least, F.least(F.lit(most), F.nanvl(F.coalesce(delta.try_cast("double"), least), least)))
