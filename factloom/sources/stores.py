"""Tables from JSON documents and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The lists of a store document, by table.
STORE_TABLES = {"entities": "churches", "evidence": "evidence", "runs": "runs", "reviews": "reviews", "dossiers": "dossiers", "conflicts": "conflicts"}


def read_store(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """Rows of one list of a JSON document, or of several documents."""
    name = STORE_TABLES[table]
    whole = spark.read.option("multiLine", True).schema(f"`{name}` array<struct<{schema}>>").json(path)
    return whole.select(F.inline(name))


def read_field_maps(spark: SparkSession, path: str) -> DataFrame:
    """key, value, confidence of every document under ``path``, with its file name
    as entity. A value may stand alone or with a confidence; names that begin with
    an underscore are notes."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("entity_id"), F.from_json("value", "map<string, string>").alias("m"))
    cells = raw.select("entity_id", F.explode("m").alias("key", "v")).where(~F.startswith("key", F.lit("_")))
    inner = F.when(F.startswith(F.trim("v"), F.lit("{")), F.from_json("v", "struct<value: string, confidence: double>"))
    nested = inner.isNotNull()
    return cells.select("entity_id", "key", F.when(nested, inner["value"]).otherwise(F.col("v")).alias("value"), inner["confidence"].alias("confidence"))


def read_calibration_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema("id string, name string, city string, state string, url string").json(path)


def read_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A table of a database, read in parallel if the options say how."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
