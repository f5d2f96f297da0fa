"""Texts that searches and models are asked with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _given(*parts: Column) -> list[Column]:
    return [F.nullif(p, F.lit("")) for p in parts]


def discovery_query(name: Column, city: Column, state: Column) -> Column:
    return F.concat_ws(" ", *_given(name, city, state), F.lit("church"))


def entity_header(name: Column, city: Column, state: Column, website: Column, phone: Column, email: Column) -> Column:
    none = lambda c: F.coalesce(c, F.lit("none"))
    rows = [("CHURCH", F.coalesce(name, F.lit(""))), ("LOCATION", F.concat_ws(", ", *_given(city, state))), ("ORIGINAL WEBSITE", none(website)), ("ORIGINAL PHONE", none(phone)), ("ORIGINAL EMAIL", none(email))]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), value) for label, value in rows))


# What is searched for beside name and place, in order; the second and the last ask by name.
TOPICS = [
    "church", None, "pastor staff leadership team", "attendance members weekly service times", "facebook instagram", "youtube sermons livestream watch online",
    "church center subsplash planning center app giving", "jobs hiring pastor position careers", "network association denomination district", None,
]


def snippet_queries(entities: DataFrame, key: str = "id") -> DataFrame:
    """Ten queries for each entity: key, query_no, query; needs name, city, state,
    official_host (null: none known)."""
    base = F.concat_ws(" ", *_given(F.col("name"), F.col("city"), F.col("state")))
    town = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("city", F.lit("")))
    by_name = {1: F.when(F.col("official_host").isNotNull(), F.concat(F.lit("site:"), "official_host")).otherwise(F.concat(town, F.lit(" pastor"))), 9: F.concat(town, F.lit(" news article announcement"))}
    made = F.array(*(by_name.get(i, F.concat(base, F.lit(f" {topic}"))) for i, topic in enumerate(TOPICS)))
    return entities.select(key, F.posexplode(made).alias("query_no", "query")).where(F.length(F.trim("query")) > 3)
