"""Closed-form points and edge rows of the scores."""

import math

import pytest
from pyspark.sql import functions as F

from tidepool.config import deep_merge, settings
from tidepool.functions import scoring, text, vectors
from tidepool.functions.fuzzy import partial_ratio


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


@pytest.mark.parametrize("days, want, tolerance", [(0, 2.0, 1e-9), (36 * math.log(2) / 24, 1.5, 1e-9), (1.5, 1.368, 0.001), (3, 1.135, 0.001), (30, 1.0, 0.001)])
def test_freshness(spark, days, want, tolerance):
    assert abs(one(spark, scoring.freshness(F.lit(float(days))))[0] - want) <= tolerance


@pytest.mark.parametrize("hours, want", [(None, 1.0), (-3, 0.3), (0, 0.3), (12, 0.475), (24, 0.65), (48, 1.0), (60, 1.0)])
def test_cooldown(spark, hours, want):
    assert one(spark, scoring.cooldown(F.lit(hours).cast("double")))[0] == want


def score(spark, **given):
    v = {"kind": "dynamic", "importance": "7", "activations": 3.0, "days": 2.0, "arousal": "0.5", "resolved": None, "digested": None, "pinned": None, "protected": None} | given
    kinds = {"kind": "string", "importance": "string", "activations": "double", "days": "double", "arousal": "string"}
    return one(spark, scoring.decay_score(*[F.lit(v[k]).cast(kinds.get(k, "boolean")) for k in v]))[0]


def test_decay_score(spark):
    fresh = 1 + math.exp(-24 * 2 / 36)
    want = round(7 * 3**0.3 * math.exp(-0.1) * (0.7 * fresh + 0.3 * 1.4), 4)
    assert score(spark) == pytest.approx(want, abs=1e-4)
    assert score(spark, pinned=True) == score(spark, kind="permanent") == score(spark, protected=True) == 999.0
    assert score(spark, kind="feel") == 50.0
    assert score(spark, resolved=True) == pytest.approx(want * 0.05, rel=1e-2)
    assert score(spark, resolved=True, digested=True) == pytest.approx(want * 0.02, rel=1e-2)
    assert score(spark, digested=True) == score(spark) == score(spark, kind=None)
    assert score(spark, arousal="0.9") > 1.5 * score(spark, arousal="0.5")
    assert score(spark, activations=3.9) == score(spark)
    assert score(spark, importance="x") == score(spark, importance="5") and score(spark, importance="99") == score(spark, importance="10")
    assert score(spark, arousal="high") == score(spark, arousal="0.3")
    days = [score(spark, days=float(d)) for d in (0, 1, 2, 3, 5, 10, 40, 200)]
    assert days == sorted(days, reverse=True)


def test_times(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    for given, want in [("2024-01-30T00:00:00", 1.0), ("2024-01-30", 1.0), ("2024-01-30T12:00:00.5", 0.5), ("2024-01-30T00:00:00+08:00", 30.0), ("2024", 30.0), ("soon", 30.0), (None, 30.0), ("2025-01-01", 0.0)]:
        assert one(spark, scoring.days_between(scoring.parsed_time(F.lit(given).cast("string")), now))[0] == pytest.approx(want, abs=1e-4), given


def test_emotion_and_mood(spark):
    lit = lambda *xs: [F.lit(x).cast("double") for x in xs]
    assert one(spark, scoring.emotion_match(*lit(0.5, 0.5, 0.5, 0.5)))[0] == 1.0
    assert one(spark, scoring.emotion_match(*lit(None, 0.5, 0.5, 0.5)))[0] == 0.5
    assert one(spark, scoring.emotion_match(*lit(0, 0, 1, 1)))[0] == 0.0
    assert [round(one(spark, scoring.mood_decay(*lit(1.0, rest, 90)))[0], 3) for rest in (0.56, 0.34, 0.12)] == [0.78, 0.67, 0.56]
    assert one(spark, scoring.mood_decay(*lit(0.9, 0.5, -5)))[0] == 0.9
    assert one(spark, *[scoring.limited(F.lit(x).cast("string"), 0.18).alias(f"c{i}") for i, x in enumerate(["10", "-10", "0.1", "x", None, "NaN"])]) == (0.18, -0.18, 0.1, -0.18, -0.18, -0.18)
    assert one(spark, scoring.clamp(F.lit(None).cast("double"), 0, 1))[0] is None


def test_text(spark):
    t = [text.token_estimate(F.lit(x)).alias(f"c{i}") for i, x in enumerate(["", "猫", "hello world"])]
    assert one(spark, *t) == (0, 1, 3)
    assert one(spark, text.without_links(F.lit("a [[b c]] [[d]e]]")))[0] == "a b c [[d]e]]"
    assert one(spark, *[text.safe_name(F.lit(x)).alias(f"c{i}") for i, x in enumerate([" é テ-x? ", "???", "", "a" * 99])]) == ("é テ-x", "unnamed", "unnamed", "a" * 80)


def test_cosine(spark):
    arrays = [([1, 0], [1, 0], 1.0), ([1, 0], [0, 1], 0.0), ([], [], 0.0), ([0, 0], [1, 1], 0.0), ([1], [1, 2], 0.0), ([3, 4], [4, 3], 0.96)]
    for a, b, want in arrays:
        got = one(spark, vectors.cosine(*[F.array(*[F.lit(float(x)) for x in v]).cast("array<double>") for v in (a, b)]))[0]
        assert got == pytest.approx(want)


def test_partial_ratio():
    assert partial_ratio("abc", "xxabcxx") == 100.0 == partial_ratio("xxabcxx", "abc")
    assert partial_ratio("", "a") == 0.0 and partial_ratio("", "") == 100.0 and partial_ratio("q", "abc") == 0.0
    assert partial_ratio("abcd", "xabxcdx") == pytest.approx(75.0, abs=11)
    for a, b in [("hello", "yellow"), ("abab", "ba"), ("kitten", "sitting")]:
        assert partial_ratio(a, b) == partial_ratio(b, a) and 0 <= partial_ratio(a, b) <= 100


def test_settings():
    assert settings({"decay": {"rate": 0.1}}).decay.rate == 0.1
    assert deep_merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    with pytest.raises(TypeError):
        settings({"decay": {"nothing": 1}})
