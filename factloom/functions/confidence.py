"""Confidence: caps by access level, gates, bands and tiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.config import ACCESS_LEVELS, SETTINGS, Settings


def ladder(score: Column, steps: list[tuple[float, str]], lowest: str) -> Column:
    """Label of the first step, from the highest down, that the score reaches."""
    out = F.lit(lowest)
    for least, label in reversed(steps):
        out = F.when(score >= least, F.lit(label)).otherwise(out)
    return out


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up, towards plus infinity, as opposed to half away from zero."""
    return F.floor(x * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def _by_level(level: Column, values: list) -> Column:
    out = F.lit(None)
    for (name, _, _), value in zip(ACCESS_LEVELS, values, strict=True):
        out = F.when(level == name, F.lit(value)).otherwise(out)
    return out


def reliability(level: Column) -> Column:
    return _by_level(level, [r for _, r, _ in ACCESS_LEVELS]).cast("double")


def access_rank(level: Column) -> Column:
    """Position of an access level, weakest 0; unknown ones are -1."""
    return F.coalesce(_by_level(level, list(range(len(ACCESS_LEVELS)))), F.lit(-1)).cast("int")


def level_of_rank(rank: Column) -> Column:
    return F.get(F.array(*(F.lit(n) for n, _, _ in ACCESS_LEVELS)), rank)


def cap_for_access(level: Column) -> Column:
    return _by_level(level, [c for _, _, c in ACCESS_LEVELS]).cast("int")


def cap_confidence(raw: Column, level: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(cap_for_access(level).cast("double"), rounded(raw.cast("double"))))


def clamp_confidence(x: Column) -> Column:
    """0 to 100 with two digits; what isn't finite is 0."""
    x = x.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), rounded(x, 2)))).otherwise(0.0)


def confidence_band(score: Column) -> Column:
    steps = [(90, "direct-official"), (75, "strong-multi-source"), (60, "plausible-incomplete"), (40, "weak-indirect")]
    return ladder(score, steps, "insufficient")


def confidence_tier(score: Column) -> Column:
    return ladder(score, [(75, "High"), (55, "Medium"), (35, "Low")], "Very Low")


def decide_update(score: Column, settings: Settings = SETTINGS) -> Column:
    return ladder(score, [(settings.auto_update, "update"), (settings.review, "review")], "evidence_only")
