"""Strict schemas of model answers: every violated path of a value is a row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A member of an answer: its kind (string, number, strings, objects), whether it
    may be null, the range of a number, the options of a string, the members of objects."""

    name: str
    kind: str = "string"
    nullable: bool = False
    low: float | None = None
    high: float | None = None
    options: tuple[str, ...] = ()
    members: tuple["Field", ...] = ()


def _text(name: str) -> Field:
    return Field(name)


def _maybe(name: str, kind: str = "string") -> Field:
    return Field(name, kind, nullable=True)


def _percent(name: str) -> Field:
    return Field(name, "number", low=0, high=100)


EVIDENCE = Field("evidence", "objects", members=(_text("field_name"), _maybe("proposed_value"), _text("evidence_text"), _maybe("source_url"), _percent("confidence_score")))
# The members that each answer must have, their ranges and options.
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "verification": (
        Field("active_status", options=("Verified Active", "Likely Active", "Uncertain", "Closed", "Merged")), _maybe("website_verified"), _percent("website_verified_confidence"),
        _percent("active_status_confidence"), Field("closure_merger_signals", "strings"), _text("reasoning"), EVIDENCE,
    ),
    "contact": (_maybe("email_verified"), _percent("email_confidence"), _maybe("phone_verified"), _percent("phone_confidence"), _maybe("lead_pastor"), _percent("lead_pastor_confidence"), EVIDENCE),
    "denomination": (_text("denomination"), _percent("denomination_confidence"), _text("network_affiliation"), _percent("network_confidence"), EVIDENCE),
    "size": (
        _maybe("attendance_estimate", "number"), _maybe("attendance_min", "number"), _maybe("attendance_max", "number"), _percent("attendance_confidence"),
        Field("attendance_confidence_tier", options=("High", "Medium", "Low", "Very Low")), _maybe("staff_count", "number"), _maybe("campus_count", "number"), _maybe("weekend_services_count", "number"),
        _text("reasoning"), EVIDENCE,
    ),
    "multiplication": (
        *(_percent(x) for x in ("church_planting_activity", "disciple_making", "leadership_development", "residency_internship", "mission_sending", "kingdom_collaboration", "innovation", "multiplication_orientation", "digital_reach")),
        _text("explanation"), EVIDENCE,
    ),
}

RULE = "of_schema string, o1 int, o3 int, name string, kind string, nullable boolean, low double, high double, options array<string>, inner string"
#: Kinds of members that are arrays, and of what.
INNER = {"strings": "string", "objects": "object"}


def _rules(name: str, fields: tuple[Field, ...], outer: int | None = None) -> list[tuple]:
    """A schema as rows; members of objects, with their outer member's number, have numbers of their own."""
    rows = []
    for i, f in enumerate(fields):
        o1, o3 = (i, -1) if outer is None else (outer, i)
        rows.append((name, o1, o3, f.name, "array" if f.kind in INNER else f.kind, f.nullable, f.low, f.high, list(f.options) or None, INNER.get(f.kind)))
        rows += _rules(name, f.members, i)
    return [tuple(float(x) if k in (6, 7) and x is not None else x for k, x in enumerate(r)) for r in rows]


def kind_of(value: Column) -> Column:
    """What a variant is: undefined (there is none), null, string, number, boolean, object or array."""
    # the type is told once, however many kinds are asked for
    told = F.transform(F.array(F.schema_of_variant(value)), lambda t: F.when(t.isNull(), "undefined").when(t == "VOID", "null").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("number"))
    return F.get(told, F.lit(0))


def _judged(values: DataFrame, keys: list[str]) -> DataFrame:
    """The violations among values with the columns of a rule, their order, path and value."""
    seen = values.withColumns({"found": kind_of(F.col("value")), "text": F.try_variant_get("value", "$", "string"), "n": F.try_variant_get("value", "$", "double")})
    fits = (F.col("found") == F.col("kind")) | (F.col("nullable") & (F.col("found") == "null"))
    number = F.col("found") == "number"
    problem = (
        F.when(~fits, "invalid_type")
        .when((F.col("found") == "string") & ~F.array_contains("options", F.col("text")), "invalid_enum_value")
        .when(number & (F.col("n") < F.col("low")), "too_small")
        .when(number & (F.col("n") > F.col("high")), "too_big")
    )
    limit = lambda word, x: F.concat(F.lit(word), F.regexp_replace(F.col(x).cast("string"), r"\.0$", ""))
    wrong = seen.withColumn("problem", problem).where("problem is not null")
    is_ = lambda x: F.col("problem") == x
    expected = F.when(is_("invalid_type"), F.col("kind")).when(is_("invalid_enum_value"), F.array_join("options", "|")).when(is_("too_small"), limit("at least ", "low")).otherwise(limit("at most ", "high"))
    return wrong.select(*keys, "o1", "o2", "o3", "path", "problem", expected.alias("expected"), F.when(is_("invalid_type"), F.col("found")).otherwise(F.col("text")).alias("found"))


def violations(answers: DataFrame, keys: list[str], json_col: str = "json", schema_col: str = "schema_name", schemas: dict[str, tuple[Field, ...]] = SCHEMAS) -> DataFrame:
    """A row per violated path: keys, violation_no (from 0, in the schema's order), path,
    problem, expected, found.

    ``keys`` tell the answers apart. A text that is no JSON, or no object, is one
    violation at the empty path; members that the schema doesn't name don't matter, and
    an answer whose schema isn't known has no row. Every value meets its rule as a row,
    the schemas being a small table, so plans stay small however large a schema is.
    """
    spark = answers.sparkSession
    all_ = [r for name, fields in schemas.items() for r in _rules(name, fields)]
    top = F.broadcast(spark.createDataFrame([r for r in all_ if r[2] < 0], RULE))
    member = F.broadcast(spark.createDataFrame([r for r in all_ if r[2] >= 0], RULE).drop("inner"))
    given = answers.where(F.col(schema_col).isin(*schemas)).select(*keys, F.col(schema_col).alias("of_schema"), F.try_parse_json(json_col).alias("root"))
    given = given.withColumn("whole", kind_of(F.col("root")))
    none = F.lit(-1)
    bare = given.where("whole <> 'object'").select(*keys, none.alias("o1"), none.alias("o2"), none.alias("o3"), F.lit("").alias("path"), F.lit("invalid_type").alias("problem"), F.lit("object").alias("expected"), F.when(F.col("root").isNull(), "no JSON").otherwise(F.col("whole")).alias("found"))
    rule = ["kind", "nullable", "low", "high", "options"]
    tops = given.where("whole = 'object'").join(top, "of_schema").select(*keys, "of_schema", "o1", none.alias("o2"), "o3", F.col("name").alias("path"), *rule, "inner", F.try_variant_get("root", F.concat(F.lit("$."), F.col("name")), "variant").alias("value"))
    items = tops.where("inner is not null").select(*keys, "of_schema", "o1", F.posexplode(F.try_variant_get("value", "$", "array<variant>")).alias("o2", "value"), "path", F.col("inner").alias("kind"))
    items = items.withColumn("path", F.concat("path", F.lit("["), F.col("o2").cast("string"), F.lit("]")))
    plain = {"nullable": F.lit(False), "low": F.lit(None).cast("double"), "high": F.lit(None).cast("double"), "options": F.lit(None).cast("array<string>")}
    inner = items.where("kind = 'object'").where(kind_of(F.col("value")) == "object").drop("kind").join(member, ["of_schema", "o1"])
    inner = inner.select(*keys, "o1", "o2", "o3", F.concat("path", F.lit("."), F.col("name")).alias("path"), *rule, F.try_variant_get("value", F.concat(F.lit("$."), F.col("name")), "variant").alias("value"))
    found = bare.unionByName(_judged(tops, keys)).unionByName(_judged(items.withColumns({"o3": none, **plain}), keys)).unionByName(_judged(inner, keys))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("o1", "o2", "o3"))
    return found.select(*keys, (order - 1).alias("violation_no"), "path", "problem", "expected", "found")


def _type(field: Field) -> str:
    inner = ", ".join(f"{m.name}: {_type(m)}" for m in field.members)
    return {"string": "string", "number": "double", "strings": "array<string>", "objects": f"array<struct<{inner}>>"}[field.kind]


def typed(answers: DataFrame, name: str, keys: list[str], json_col: str = "json", schema_col: str = "schema_name", schemas: dict[str, tuple[Field, ...]] = SCHEMAS) -> DataFrame:
    """The valid answers under the schema ``name`` with its members as the column ``a``."""
    mine = answers.where(F.col(schema_col) == name)
    wrong = violations(mine, keys, json_col, schema_col, {name: schemas[name]}).select(*keys).distinct()
    shape = "struct<" + ", ".join(f"{f.name}: {_type(f)}" for f in schemas[name]) + ">"
    return mine.join(wrong, keys, "left_anti").withColumn("a", F.from_json(json_col, shape))
