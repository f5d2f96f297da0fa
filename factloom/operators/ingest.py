"""Roster ingest: header inference, quality flags, first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.config import HEADER_SYNONYMS


def detect_columns(headers: list[str | None]) -> dict[str, int]:
    """Position of each target field: the first header that is one of its synonyms,
    else the first that contains one. A header may serve several fields."""
    names = [(h or "").strip().lower() for h in headers]
    found = {}
    for field, words in HEADER_SYNONYMS.items():
        exact = [i for i, h in enumerate(names) if h in words]
        partly = [i for i, h in enumerate(names) if h and any(w in h for w in words)]
        if exact or partly:
            found[field] = (exact or partly)[0]
    return found


def cell(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_bad_name(name: Column) -> Column:
    """Missing, a time of day, or a number."""
    return name.isNull() | name.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") | name.rlike(r"^\d+(\.\d+)?$")


def has_content() -> Column:
    return F.coalesce("name", "address", "phone_original", "email_original").isNotNull()


def map_roster(raw: DataFrame, positions: dict[str, int], keep_empty: bool = False) -> DataFrame:
    """Records from rows of cells; ``raw`` has row_idx and cells (strings), without
    the header. Rows without name, address, phone and email are left out, unless
    ``keep_empty``."""
    at = lambda f: cell(F.get("cells", F.lit(positions[f]))) if f in positions else F.lit(None).cast("string")
    name, parent, other = at("name"), at("parent"), at("urlname")
    shown = F.concat(F.lit('suspect name value "'), F.coalesce(name, F.lit("null")), F.lit('" — needs manual review'))
    warning = F.when(is_bad_name(name), shown)
    notes = F.concat_ws(
        " | ",
        F.concat(F.lit("Seed parent org: "), parent),
        F.concat(F.lit("Seed alt name: "), other),
        F.concat(F.lit("Import warnings: "), warning),
    )
    rows = raw.select(
        "row_idx",
        F.concat(F.lit("row-"), F.coalesce(at("rowid"), F.col("row_idx").cast("string"))).alias("original_row_id"),
        name.alias("name"),
        F.nullif(F.concat_ws(", ", at("address1"), at("address2")), F.lit("")).alias("address"),
        at("city").alias("city"),
        at("state").alias("state"),
        at("zip").alias("zip"),
        F.coalesce(at("country"), F.lit("United States")).alias("country"),
        at("phone").alias("phone_original"),
        at("email").alias("email_original"),
        at("website").alias("website_original"),
        F.regexp_replace(at("language"), r"^\s*,?\s*", "").alias("language"),
        parent.alias("network_affiliation"),
        F.nullif(notes, F.lit("")).alias("notes"),
        warning.isNotNull().alias("suspect"),
    )
    return rows if keep_empty else rows.where(has_content())


def read_roster(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """Rows of cells of a CSV file as text, numbered from 1 in file order, and its
    header, as it is written. ``limit`` keeps the first rows only.

    Rows are numbered by their partition's offset, so numbers are dense and depend
    on the file alone; only a count for each partition is collected.
    """
    whole = spark.read.option("header", False).option("inferSchema", False).csv(path)
    cells = whole.select(F.monotonically_increasing_id().alias("at"), F.array(*whole.columns).alias("cells"))
    part = F.shiftright("at", 33)
    counts = sorted((r["part"], r["n"]) for r in cells.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return spark.createDataFrame([], "row_idx long, cells array<string>"), []
    first, offsets = 0, []
    for k, n in counts:
        offsets.append((k, first))
        first += n
    starts = F.create_map(*(F.lit(x) for pair in offsets for x in pair))
    rows = cells.select((starts[part] + F.col("at").bitwiseAND((1 << 33) - 1)).cast("long").alias("row_idx"), "cells")
    header = rows.where("row_idx = 0").first()["cells"]
    data = rows.where(F.col("row_idx") > 0)
    return (data.where(F.col("row_idx") <= limit) if limit else data), header


def import_summary(records: DataFrame, existing: DataFrame) -> DataFrame:
    """How many rows are new, were there before or repeat, have warnings, and how
    many there are. Rows without content count in the total, and in the warnings,
    but are neither imported nor skipped; ``records`` has them (``keep_empty``)."""
    kept = records.where(has_content())
    new = kept.select("original_row_id").distinct().join(existing.select("original_row_id"), "original_row_id", "left_anti").agg(F.count(F.lit(1)).alias("imported"))
    counts = records.agg(F.count(F.lit(1)).alias("total"), F.count_if("suspect").alias("warnings"), F.count_if(has_content()).alias("kept"))
    return counts.crossJoin(new).select("imported", (F.col("kept") - F.col("imported")).alias("skipped"), "warnings", "total")


def alternative_name(notes: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(notes, r"(?i)Seed alt name:\s*([^|]+)", 1)), F.lit(""))


def slug(text: Column, default: str = "entity") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(made, 1, 60), F.lit("")), F.lit(default))
