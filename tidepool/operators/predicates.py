"""Row predicates over the memory table, safe for nulls: an absent flag is false, an absent type is none of the named ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.config import DecaySettings
from tidepool.functions.scoring import flag


def type_in(*names: str) -> Column:
    return F.coalesce(F.col("type").isin(*names), F.lit(False))


def is_core() -> Column:
    return flag(F.col("pinned")) | flag(F.col("protected"))


def can_surface() -> Column:
    return ~flag(F.col("resolved")) & ~type_in("permanent", "feel") & ~is_core()


def can_dream() -> Column:
    return ~type_in("permanent", "feel") & ~is_core()


def can_be_recalled() -> Column:
    return ~type_in("feel", "permanent", "archived") & ~flag(F.col("resolved")) & ~is_core()


def is_recent(now: Column, hours: float) -> Column:
    """A plain range on ``created``, so that it reaches the scan."""
    return ~type_in("feel") & ~is_core() & (F.col("created") >= F.timestamp_add("MINUTE", F.lit(int(-60 * hours)), now))


def in_patterns() -> Column:
    return type_in("dynamic") & ~flag(F.col("pinned")) & ~flag(F.col("resolved"))


decays = can_dream
ripples = can_dream


def resolves_itself(days: Column, s: DecaySettings = DecaySettings()) -> Column:
    return ~flag(F.col("resolved")) & (F.coalesce("importance", F.lit(5)) <= s.auto_resolve_importance) & (F.coalesce(days, F.lit(999.0)) > s.auto_resolve_days)


def fades(score: Column, s: DecaySettings = DecaySettings()) -> Column:
    return score < s.archive_below


def valid_mood(x: Column) -> Column:
    """A mood from 0 to 1, else null."""
    return F.when(x.between(0, 1), x)


def is_broken() -> Column:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return empty("name") | empty("content") | F.coalesce(F.size("domain") < 1, F.lit(True))


def in_domains(df: DataFrame, domains: list[str]) -> DataFrame:
    """Rows of any of the domains, whatever their case; all rows if there are none. One row of a count decides, in the same plan."""
    wanted = F.array(*[F.lit(d.lower()) for d in domains])
    hit = F.coalesce(F.arrays_overlap(F.transform("domain", lambda d: F.lower(d)), wanted), F.lit(False))
    any_hit = df.agg(F.coalesce(F.max(hit), F.lit(False)).alias("any_hit"))
    return df.withColumn("hit", hit).join(F.broadcast(any_hit)).where(F.col("hit") | ~F.col("any_hit")).drop("hit", "any_hit")  # one row
