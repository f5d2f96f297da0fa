"""Weighted 0 to 100 scores. Sub-scores are clamped first; sums have one digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.config import MAJOR_NETWORKS
from factloom.functions.confidence import rounded


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x.cast("double")))


def weighted(parts: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for part, weight in parts:
        total = total + part * F.lit(weight)
    return rounded(total, 1)


def attendance_sub_score(attendance: Column) -> Column:
    """Logarithmic: 10 gives 0, 10,000 gives 100; null or not positive gives 0."""
    x = attendance.cast("double")
    return F.when(x > 0, clamp((F.log10(x) - 1) / 3 * 100)).otherwise(0.0)


def complexity_sub_score(campuses: Column, services: Column, staff: Column) -> Column:
    above = lambda c: clamp((F.coalesce(c.cast("double"), F.lit(1.0)) - 1) / 4 * 100)
    people = clamp(F.coalesce(staff.cast("double"), F.lit(0.0)) / 50 * 100)
    return clamp(above(campuses) * 0.4 + above(services) * 0.25 + people * 0.35)


def network_sub_score(denomination: Column, network: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(denomination, F.lit("")), F.lit(" "), F.coalesce(network, F.lit(""))))
    major = F.lit(False)
    for name in MAJOR_NETWORKS:
        major = major | text.contains(name)
    return (
        F.when((F.trim(text) == "") | text.contains("unknown"), 20.0)
        .when(major, 75.0)
        .when(text.contains("independent") | text.contains("non-denominational"), 45.0)
        .otherwise(50.0)
    )


def influence_score(attendance: Column, complexity: Column, digital: Column, network: Column, leadership: Column) -> Column:
    return weighted([(attendance, 0.3), (complexity, 0.2), (clamp(digital), 0.2), (network, 0.15), (clamp(leadership), 0.15)])


def fit_score(language: Column, planting: Column, leadership: Column, collaboration: Column, innovation: Column) -> Column:
    return weighted([(clamp(language), 0.3), (clamp(planting), 0.25), (clamp(leadership), 0.2), (clamp(collaboration), 0.15), (clamp(innovation), 0.1)])


def multiplication_score(language: Column, planting: Column, leadership: Column, innovation: Column) -> Column:
    return weighted([(clamp(language), 0.35), (clamp(planting), 0.35), (clamp(leadership), 0.2), (clamp(innovation), 0.1)])


def verification_score(status: Column, website: Column) -> Column:
    return clamp(status.cast("double") * 0.6 + website.cast("double") * 0.4)


def run_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return tokens_in / F.lit(1e6) * F.lit(price_in) + tokens_out / F.lit(1e6) * F.lit(price_out)
