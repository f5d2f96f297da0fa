"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.plans import answers, crawl, export, reading, records  # noqa: F401  (they register their queries)
from factloom.plans.catalogue import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best fact per entity and field, and what becomes of it."""
    return QUERIES["fact_resolution"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
