"""Best fact per field, conflicts between sources, and source statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.config import STRUCTURED_FACTS
from factloom.functions import confidence as C
from factloom.operators.ranking import first_per


def best_facts(candidates: DataFrame) -> DataFrame:
    """Candidate with the highest reliability times confidence per entity and
    field; the earliest (seq) of equal ones. Empty values don't count.

    Needs entity_id, field_name, value, confidence, reliability, seq.
    """
    usable = candidates.where(F.col("value").isNotNull() & (F.col("value") != ""))
    scored = usable.withColumn("score", F.col("reliability") * F.col("confidence"))
    return first_per(scored, ["entity_id", "field_name"], [F.desc("score"), F.asc("seq")])


def structured_candidates(fields: DataFrame) -> DataFrame:
    """Structured fields under the names of the facts they speak for."""
    names = F.create_map(*(F.lit(x) for pair in STRUCTURED_FACTS.items() for x in pair))
    target = fields.withColumn("field_name", names[F.col("field_name")]).where(F.col("field_name").isNotNull() & (F.coalesce("value", F.lit("")) != ""))
    # a head count must be a number
    return target.where((F.col("field_name") != "staff_count") | F.col("value").try_cast("double").isNotNull())


def norm_for_conflict(field: Column, value: Column) -> Column:
    """What of a value is compared: the role, the digits, or letters and digits."""
    low = F.lower(value)
    role = F.regexp_extract(low, r"lead|senior|associate|executive|founding", 0)
    return (
        F.when(field == "lead_pastor_title_mention", F.when(role != "", role).otherwise(low))
        .when(field == "phone", F.regexp_replace(value, r"\D", ""))
        .when(field == "address", F.regexp_replace(low, r"[^a-z0-9]", ""))
    )


def conflicts(fields: DataFrame) -> DataFrame:
    """Fields on which an entity's sources disagree: the most reliable value, the
    next that differs, and a confidence for the first.

    Needs entity_id, key, value, norm, reliability, access_level, seq.
    """
    # one pass of partial aggregation: the best row, and the best of each norm
    row = F.struct("value", "access_level", "norm")
    rank = F.struct((-F.col("reliability")).alias("r"), F.col("seq"))
    norms = fields.groupBy("entity_id", "key", "norm").agg(F.min(F.struct(rank.alias("rank"), row.alias("row"))).alias("best"))
    return _two_best(norms).select(
        "entity_id", "key", F.col("a.row.value").alias("value_a"), F.col("a.row.access_level").alias("level_a"), F.col("b.row.value").alias("value_b"), F.col("b.row.access_level").alias("level_b")
    ).withColumn("confidence", C.cap_confidence(F.lit(60.0), F.col("level_a")))


def _two_best(norms: DataFrame) -> DataFrame:
    """The best and the next best value of each field that has several."""
    at = F.row_number().over(Window.partitionBy("entity_id", "key").orderBy("best"))
    placed = norms.withColumn("at", at).where("at <= 2")
    both = placed.groupBy("entity_id", "key").agg(F.max(F.when(F.col("at") == 1, F.col("best"))).alias("a"), F.max(F.when(F.col("at") == 2, F.col("best"))).alias("b"))
    return both.where("b is not null")


def conflict_records(found: DataFrame, as_of: Column) -> DataFrame:
    """Conflicts as rows of the log: an id that the content gives, open, with the
    time of the finding."""
    id_ = F.md5(F.concat_ws("|", F.col("entity_id").cast("string"), "key", "value_a", "value_b"))
    return found.select(
        id_.alias("id"), "entity_id", F.col("key").alias("field_name"), "value_a", "value_b", F.col("value_a").alias("recommended_value"), "confidence", F.lit("open").alias("status"), as_of.alias("created_at")
    )


def source_urls(*urls: Column) -> Column:
    """Distinct addresses in order, without the missing ones."""
    return F.array_distinct(F.filter(F.array(*urls), lambda u: u.isNotNull() & (u != "")))


def source_statistics(findings: DataFrame) -> DataFrame:
    """Per entity: best access level, counts by kind of source, whether the own
    site was read, and the confidence in the research before conflicts.

    Needs entity_id, source_type, access_level, fetched.
    """
    official = F.col("access_level").isin("live_official_site", "staff_profile")
    crawled = (F.col("access_level") == "live_official_site") & F.col("fetched")
    return findings.groupBy("entity_id").agg(
        F.coalesce(C.level_of_rank(F.max(C.access_rank(F.col("access_level")))), F.lit("search_snippets")).alias("access_level"),
        F.bool_or(crawled).alias("official_crawled"),
        F.countDistinct("source_type").alias("source_types"),
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(official).alias("official_source_count"),
        F.count_if(~official).alias("secondary_source_count"),
    )


def research_confidence(types: Column, crawled: Column, findings: Column, n_conflicts: Column, level: Column) -> Column:
    raw = F.least(types / F.lit(8.0), F.lit(1.0)) * 55 + F.when(crawled, 25).otherwise(0) + F.when(findings >= 5, 15).otherwise(5) - n_conflicts * 4
    return C.cap_confidence(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), level)


def estimates(synthesis: DataFrame, facts: DataFrame) -> DataFrame:
    """Field estimates of the synthesis and of the facts, each capped by its own
    access level; an estimate without one has that of its dossier.

    Need entity_id, field_name, value, confidence, access_level; synthesis also
    dossier_level.
    """
    level = F.when(C.access_rank(F.col("access_level")) >= 0, F.col("access_level")).otherwise(F.col("dossier_level"))
    own = synthesis.select("entity_id", "field_name", "value", "confidence", level.alias("access_level"), F.lit(0).alias("origin"))
    return own.unionByName(facts.select("entity_id", "field_name", "value", "confidence", "access_level", F.lit(1).alias("origin"))).withColumn(
        "confidence", C.cap_confidence(F.col("confidence"), F.col("access_level"))
    )
