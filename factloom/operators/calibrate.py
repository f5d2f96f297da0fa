"""Comparison of two sets of field values with the truth, and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.config import CALIBRATION_FIELDS
from factloom.functions import confidence as C


def field_specs(spark: SparkSession) -> DataFrame:
    rows = [(i, *f) for i, f in enumerate(CALIBRATION_FIELDS)]
    return spark.createDataFrame(rows, "field_no int, key string, type string, tol double, meta boolean")


def to_number(v: Column) -> Column:
    """First number of a text, with thousands separators and a k or m after it."""
    plain = F.replace(v, F.lit(","), F.lit(""))
    pattern = r"(-?\d+(?:\.\d+)?)\s*([kKmM])?"
    unit = F.lower(F.regexp_extract(plain, pattern, 2))
    return F.regexp_extract(plain, pattern, 1).try_cast("double") * F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)


def stripped_number(v: Column) -> Column:
    """Number of a text without all else than digits, points and signs."""
    return F.regexp_extract(F.regexp_replace(v, r"[^0-9.\-]", ""), r"^(-?\d*\.?\d+)", 1).try_cast("double")


def to_bool(v: Column) -> Column:
    low = F.lower(F.trim(v))
    return F.when(low.isin("true", "yes", "y", "1"), True).when(low.isin("false", "no", "n", "0"), False)


def norm(v: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), r"[^a-z0-9]+", " "))


def parsed(kind: Column, v: Column) -> Column:
    """A value as its kind is compared: number, flag, and normal form."""
    return F.struct(F.when(kind == "number", to_number(v)).alias("number"), F.when(kind == "bool", to_bool(v)).alias("flag"), norm(v).alias("norm"), is_empty(v).alias("empty"))


def _equal(kind: Column, tol: Column, a: Column, b: Column) -> Column:
    x, y, p, q = a["number"], b["number"], a["norm"], b["norm"]
    near = F.abs(x - y) <= F.greatest(F.abs(y), F.lit(1.0)) * F.coalesce(tol, F.lit(0.2))
    part = (F.length(p) > 2) & (F.length(q) > 2) & (p.contains(q) | q.contains(p))
    same = F.when(kind == "number", near).when(kind == "bool", a["flag"] == b["flag"]).when(kind == "enum", (p == q) & (p != "")).otherwise((p != "") & (q != "") & ((p == q) | part))
    return F.coalesce(same, F.lit(False))


def _distance(kind: Column, tol: Column, a: Column, truth: Column) -> Column:
    far = F.lit(float("inf"))
    relative = F.coalesce(F.abs(a["number"] - truth["number"]) / F.greatest(F.abs(truth["number"]), F.lit(1.0)), far)
    return F.when(a["empty"], far).when(kind == "number", relative).when(_equal(kind, tol, a, truth), 0.0).otherwise(1.0)


def values_equal(kind: Column, tol: Column, a: Column, b: Column) -> Column:
    return _equal(kind, tol, parsed(kind, a), parsed(kind, b))


def distance(kind: Column, tol: Column, v: Column, truth: Column) -> Column:
    return _distance(kind, tol, parsed(kind, v), parsed(kind, truth))


def is_empty(v: Column) -> Column:
    return v.isNull() | (v == "")


def compare(cells: DataFrame, entities: DataFrame) -> DataFrame:
    """A row per entity and field: the values of tool, baseline and truth, and how
    the tool's compares.

    cells: entity_id, source (tool, baseline or truth), key, value, confidence;
    entities: entity_id, access_level.
    """
    specs = F.broadcast(field_specs(cells.sparkSession))
    grid = entities.select("entity_id", "access_level", C.cap_for_access(F.col("access_level")).alias("cap")).join(specs)
    wide = cells.groupBy("entity_id", "key").agg(
        *(F.max(F.when(F.col("source") == s, F.col(c))).alias(f"{s}_{c}") for s in ("tool", "baseline", "truth") for c in ("value", "confidence"))
    )
    kind, tol = F.col("type"), F.col("tol")
    names = ("tool", "baseline", "truth")
    # in steps, so that every value is parsed once and every pair compared once
    read = grid.join(wide, ["entity_id", "key"], "left").withColumns({f"{s}_read": parsed(kind, F.col(f"{s}_value")) for s in names})
    tool, base, truth = (F.col(f"{s}_read") for s in names)
    held = read.withColumns({"right": _equal(kind, tol, tool, truth), "d": _distance(kind, tol, tool, truth), "e": _distance(kind, tol, base, truth)})
    conf, base_conf, d, e = (F.col(c) for c in ("tool_confidence", "baseline_confidence", "d", "e"))
    status = F.when(truth["empty"], "unverified").when(tool["empty"], "missing").when(F.col("right"), "correct").otherwise("wrong")
    closer = F.when(status == "unverified", "na").when(d < e, "tool").when(e < d, "baseline").when(d < float("inf"), "tie").otherwise("na")
    sure = F.coalesce(conf, F.lit(0.0))
    graded = ~F.col("meta")
    fact = lambda c: F.coalesce(c, F.lit(False))
    return held.select(
        "entity_id", "field_no", "key", "meta", "cap", "tool_value", "baseline_value", "truth_value", "tool_confidence", "baseline_confidence",
        status.alias("status"),
        ((status == "wrong") & (sure >= 60)).alias("overconfident"),
        ((status == "correct") & (sure < 50)).alias("underconfident"),
        fact(graded & (status == "correct") & (conf >= F.col("cap") - 1)).alias("capped_at_ceiling"),
        fact(graded & (status == "correct") & (base_conf - conf >= 15)).alias("cap_cost"),
        fact(graded & (conf > F.col("cap"))).alias("cap_violation"),
        closer.alias("closer_to_truth"),
    )


def summary(compared: DataFrame) -> DataFrame:
    """Counts by outcome per entity."""
    count = lambda c, name: F.count_if(c).alias(name)
    s, closer = F.col("status"), F.col("closer_to_truth")
    return compared.groupBy("entity_id").agg(
        count(s == "correct", "n_correct"), count(s == "wrong", "n_wrong"), count(s == "missing", "n_missing"),
        count(F.col("overconfident"), "n_overconfident"), count(F.col("underconfident"), "n_underconfident"), count(F.col("capped_at_ceiling"), "n_capped"),
        count(F.col("cap_cost"), "n_cap_cost"), count(F.col("cap_violation"), "n_cap_violations"), count(closer == "tool", "n_tool_closer"), count(closer == "baseline", "n_baseline_closer"),
        F.bool_or(~is_empty(F.col("truth_value"))).alias("has_ground_truth"),
    )


def readiness(growth: Column, change: Column) -> Column:
    half = lambda c: F.coalesce(c, F.lit(0.0)) * 0.5
    return F.when(growth.isNotNull() | change.isNotNull(), half(growth) + half(change))


def weight_class(digital: Column, attendance: Column) -> Column:
    return F.when(attendance > 0, digital / F.greatest(F.lit(1.0), F.log10(attendance + 10)))


def leaderboards(rows: DataFrame, n: int = 3) -> DataFrame:
    """The first n entities of each board: board, rank, entity_id, score. Equal
    scores stay in the order of seq; entities without a score don't take part."""
    growth, change, digital, attendance = (F.col(c).cast("double") for c in ("growth", "change", "digital", "attendance"))
    boards = [("most_ready", readiness(growth, change), 1), ("least_ready", readiness(growth, change), -1), ("most_open", change, 1), ("most_digital", digital, 1), ("above_weight", weight_class(digital, attendance), 1)]
    out = None
    for name, score, way in boards:
        # a sort with a limit keeps n rows of each partition; nothing else moves
        top = rows.select("entity_id", "seq", score.alias("score")).where("score is not null").orderBy(F.col("score") * F.lit(float(-way)), "seq").limit(n)
        ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score") * F.lit(float(-way)), "seq"))).select(F.lit(name).alias("board"), "rank", "entity_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out


def archetype(attendance: Column, online: Column, campuses: Column, digital: Column, growth: Column, stage: Column) -> Column:
    """Kind of organisation, by ordered rules on stage, size and reach."""
    digital, growth, stage = F.coalesce(digital, F.lit(0.0)), F.coalesce(growth, F.lit(0.0)), F.coalesce(stage, F.lit(""))
    slow, growing = stage.isin("plateaued", "declining"), growth >= 60
    by_stage = (
        F.when(stage == "plant", "Church Plant")
        .when(stage == "growing", "Growth Church")
        .when(stage == "plateaued", "Institutional Church")
        .when(stage == "declining", "Reverting Church")
        .when(stage == "established", "Healthy Regional Church")
        .otherwise("Unclassified")
    )
    return (
        F.when(stage == "relaunch_revitalization", "Revitalization Church")
        .when((attendance > 0) & (online >= 2 * attendance) & (digital >= 70), "Influence Platform")
        .when(campuses >= 2, "Multi-Campus Church")
        .when(attendance >= 2000, F.when(slow, "Plateaued Mega Church").when(growing, "Growth Church").otherwise("Healthy Regional Church"))
        .when(attendance >= 500, F.when(growing, "Growth Church").when(slow, "Institutional Church").otherwise("Healthy Regional Church"))
        .when((stage == "plant") | ((attendance < 200) & (growth >= 55)), "Church Plant")
        .when(attendance < 500, F.when(stage == "declining", "Reverting Church").otherwise("Legacy Church"))
        .otherwise(by_stage)
    )


def archetype_confidence(attendance: Column, campuses: Column, stage: Column, level: Column) -> Column:
    known = F.lit(30) + attendance.isNotNull().cast("int") * 20 + campuses.isNotNull().cast("int") * 10 + (F.coalesce(stage, F.lit("")) != "").cast("int") * 10
    return F.least(known, C.cap_for_access(level))


# Weights of what makes an organisation reachable.
CONTACT_WEIGHTS = [("lead_pastor", 30), ("executive_pastor", 15), ("operations_leader", 10), ("communications_leader", 10), ("office_email", 20), ("office_phone", 15)]


def contactability(facts: DataFrame) -> DataFrame:
    """Weighted share of the contact facts that are known, per entity."""
    weights = F.create_map(*(F.lit(x) for pair in CONTACT_WEIGHTS for x in pair))
    known = F.max(F.when(F.coalesce("value", F.lit("")) != "", weights[F.col("field_name")]))
    return facts.groupBy("entity_id", "field_name").agg(known.alias("w")).groupBy("entity_id").agg(F.coalesce(F.sum("w"), F.lit(0)).cast("int").alias("contactability"))


def lifecycle_label(stage: Column) -> Column:
    return F.when(stage == "plant", "church_plant").when(stage == "relaunch_revitalization", "revitalizing").otherwise(F.coalesce(stage, F.lit("unknown")))


def variance_flags(site: Column, values: dict[str, Column], attendance_confidence: Column, level: Column) -> Column:
    """What is missing or weak in an entity's results, without a truth to compare."""
    lacks = lambda k: F.coalesce(values[k].cast("string"), F.lit("")) == ""
    flags = [F.when(F.coalesce(site, F.lit("")) == "", F.lit("no official site"))]
    flags += [F.when(lacks(k), F.lit(f"missing contact: {k}")) for k in ("lead_pastor", "executive_pastor", "operations_leader", "communications_leader")]
    flags += [F.when(lacks("office_email"), F.lit("missing office email"))]
    flags += [F.when(values["attendance"].isNull(), F.lit("no attendance estimate")).when(F.coalesce(attendance_confidence, F.lit(0.0)) < 50, F.lit("attendance estimate is low-confidence"))]
    flags += [F.when(values[k].isNull(), F.lit(f"missing {k} score")) for k in ("digital", "growth", "change", "staff_depth")]
    flags += [F.when(level != "live_official_site", F.concat(F.lit("capped at "), level))]
    return F.array_compact(F.array(*flags))
