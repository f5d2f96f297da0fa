"""Reports as text, runs and their cost, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import SETTINGS, Settings
from factloom.functions.confidence import rounded
from factloom.functions.scoring import run_cost


def ordered_lines(line: Column, *order: str) -> Column:
    """Lines of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), "\n")


def fact_report(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """One markdown text per entity with its facts, by field."""
    line = F.concat(F.lit("- "), F.col("field_name"), F.lit(": "), F.coalesce("value", F.lit("—")), F.lit(" ("), F.col("confidence").cast("int").cast("string"), F.lit(")"))
    lists = facts.groupBy(F.col("entity_id").alias("id")).agg(ordered_lines(line, "field_name").alias("lines"))
    return entities.join(lists, "id", "left").select("id", F.concat(F.lit("# "), F.col("name"), F.lit("\n"), F.coalesce("lines", F.lit("(no facts)"))).alias("markdown"))


def run_totals(runs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Runs, tokens and cost by kind and status; needs run_type, status, tokens_in, tokens_out."""
    cost = F.sum(run_cost(F.col("tokens_in"), F.col("tokens_out"), settings.price_in, settings.price_out))
    return runs.groupBy("run_type", "status").agg(
        F.count(F.lit(1)).alias("n_runs"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), rounded(cost, 4).alias("cost_estimate")
    )


def export(df: DataFrame, path: str, kind: str | None = None) -> str:
    """Write as csv or json, by ``kind`` or the path's ending; csv otherwise.
    Spreadsheet files need a library that isn't there, so they are csv as well."""
    kind = kind or ("json" if path.endswith(".json") else "csv")
    writer = df.write.mode("overwrite")
    writer.json(path) if kind == "json" else writer.option("header", True).csv(path)
    return kind


def scaffold(entities: DataFrame, specs: DataFrame, existing: DataFrame) -> DataFrame:
    """Empty cells for every entity and field that has none yet."""
    every = entities.select("entity_id").join(F.broadcast(specs.select("key")))
    return every.join(existing.select("entity_id", "key"), ["entity_id", "key"], "left_anti").withColumn("value", F.lit(None).cast("string"))


def open_runs(wanted: DataFrame, model: str) -> DataFrame:
    """Rows of the run ledger as they are begun; needs run_id, entity_id, run_type, started_at."""
    return wanted.select("run_id", "entity_id", "run_type", F.lit("running").alias("status"), F.lit(model).alias("model_used"), "started_at")


def close_runs(runs: DataFrame, ends: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """Ledger after the ends (run_id, error_message, tokens_in, tokens_out,
    completed_at), the last of which counts: failed if there is an error, with
    tokens and cost either way. Runs without an end are still running."""
    last = ends.groupBy("run_id").agg(F.max_by(F.struct("error_message", "tokens_in", "tokens_out", "completed_at"), "completed_at").alias("e"))
    done = F.col("e").isNotNull()
    cost = rounded(run_cost(F.col("e.tokens_in"), F.col("e.tokens_out"), settings.price_in, settings.price_out), 4)
    return runs.join(last, "run_id", "left").select(
        "run_id", "entity_id", "run_type", F.when(done & F.col("e.error_message").isNotNull(), "failed").when(done, "completed").otherwise(F.col("status")).alias("status"),
        "model_used", "started_at", "e.completed_at", "e.error_message", (F.col("e.tokens_in") + F.col("e.tokens_out")).alias("tokens_used"), cost.alias("cost_estimate"),
    )
