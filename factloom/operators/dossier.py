"""The whole research result of an entity, and its export as fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.functions.scoring import clamp
from factloom.operators import facts
from factloom.operators.ranking import first_per

#: Facts that a synthesis may stand in for, with the confidence it has where it names none.
FALLBACKS, FALLBACK_CONFIDENCE = ("staff_count", "campus_count"), 40.0
#: Scores that are kept within 0 and 100.
SCORES = ("growth_orientation_score", "digital_maturity_score", "change_readiness_score", "staff_depth_score")


def contamination_flags(candidates: DataFrame) -> DataFrame:
    """entity_id, contamination: a text for each site of the same name elsewhere, in
    their order. Needs entity_id, host, url, name_full, place, kind, source."""
    other = candidates.where(F.col("name_full") & (F.col("place") == "conflict") & ((F.col("kind") == "official") | (F.col("source") == "search")))
    flag = F.concat(F.lit("Same-name church at "), "host", F.lit(" appears to be in a different city/state ("), "url", F.lit(") — not this church; do not attribute its facts here."))
    return other.groupBy("entity_id").agg(F.sort_array(F.collect_set(flag)).alias("contamination"))


def merged_facts(extracted: DataFrame, synthesis: DataFrame, levels: DataFrame) -> DataFrame:
    """One fact for each entity and field: what was extracted, or else what the synthesis
    says of the fields in FALLBACKS. Both come as rows with an origin, and the first
    origin that has a value gives the fact.

    extracted: entity_id, field_name, value, confidence, source_url, access_level (one a
    field); synthesis: entity_id, official_site and for each such field its value and
    ``<field>_confidence``; levels: entity_id, access_level.
    """
    columns = ["entity_id", "field_name", "value", "confidence", "source_url", "access_level", "origin"]
    told = extracted.withColumn("origin", F.lit("extracted")).select(*columns)
    each = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"), F.coalesce(F.nullif(F.col(f"{f}_confidence"), F.lit(0.0)), F.lit(FALLBACK_CONFIDENCE)).alias("confidence")) for f in FALLBACKS))
    guessed = synthesis.select("entity_id", F.coalesce("official_site", F.lit("")).alias("source_url"), F.inline(each)).where("value is not null").join(levels, "entity_id")
    both = told.unionByName(guessed.withColumn("origin", F.lit("synthesis")).select(*columns))
    return first_per(both, ["entity_id", "field_name"], [F.asc("origin")])


def build(entities: DataFrame, findings: DataFrame, extracted: DataFrame, conflicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """A row per entity with its identity and synthesis (the columns of ``entities``), the
    source statistics, n_conflicts, research_confidence, contamination, facts (a map),
    estimates (the highest capped confidence by field) and present (source types).

    The number of facts and source types is that of their vocabularies. Entities without
    a finding have the weakest access level that a search gives.
    """
    stats = facts.source_statistics(findings)
    present = findings.groupBy("entity_id").agg(F.sort_array(F.collect_set("source_type")).alias("present"))
    clash = conflicts.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_conflicts"), F.max(F.when(F.col("key") == "lead_pastor_role", F.struct("value_a", "confidence"))).alias("role_conflict"))
    wide = entities.join(stats, "entity_id", "left").join(present, "entity_id", "left").join(clash, "entity_id", "left").join(contamination_flags(candidates), "entity_id", "left")
    zero = F.lit(0).cast("long")
    wide = wide.withColumns({
        "access_level": F.coalesce("access_level", F.lit("search_snippets")), "official_crawled": F.coalesce("official_crawled", F.lit(False)), "n_conflicts": F.coalesce("n_conflicts", zero), "source_count": F.coalesce("source_count", zero),
        "source_types": F.coalesce("source_types", zero), "contamination": F.coalesce("contamination", F.array().cast("array<string>")), "present": F.coalesce("present", F.array().cast("array<string>")),
    })
    wide = wide.withColumn("research_confidence", facts.research_confidence(F.col("source_types"), F.col("official_crawled"), F.col("source_count"), F.col("n_conflicts"), F.col("access_level")))
    known = merged_facts(extracted, entities, wide.select("entity_id", "access_level"))
    by_name = known.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("value", "confidence", "source_url", "access_level", "origin")))).alias("facts"))
    highest = known.withColumn("confidence", C.cap_confidence(F.col("confidence"), F.col("access_level"))).groupBy("entity_id", "field_name").agg(F.max("confidence").alias("confidence"))
    estimates = highest.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "confidence"))).alias("estimates"))
    return wide.join(by_name, "entity_id", "left").join(estimates, "entity_id", "left")


def metadata(dossiers: DataFrame) -> DataFrame:
    """The twelve columns of research metadata, which are no claims and pass no gate."""
    level = F.col("access_level")
    return dossiers.select(
        F.col("entity_id").alias("id"), "lifecycle_stage", *(F.when(F.col(s).isNotNull(), clamp(F.col(s))).alias(s) for s in SCORES), level.alias("evidence_access_level"),
        (F.size("contamination") > 0).alias("identity_contamination_flag"), "research_confidence", "app_status", "app_provider", "online_attendance_estimate",
        C.cap_confidence(F.coalesce("online_attendance_confidence", F.lit(0.0)), level).alias("online_attendance_confidence"),
    )


def export_fields(dossiers: DataFrame) -> DataFrame:
    """A row for each of the fields that results are compared by: entity_id, key_no, key,
    value (as text), confidence. Each key has its own chain of sources, given as a rule:
    a fact, a fact or else the synthesis, the synthesis alone, a sign of a source, or a
    constant; confidences but for those marked are kept below the access level's cap.
    """
    c, cap = F.col, C.cap_for_access(F.col("access_level")).cast("double")
    none = F.lit(None).cast("double")
    capped = lambda x: F.when(x.isNull(), cap).otherwise(F.least(x, cap))
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    estimate = lambda k: F.try_element_at("estimates", F.lit(k))

    def of_fact(k: str) -> tuple[Column, Column]:
        return fact(k)["value"], F.when(fact(k).isNotNull(), capped(fact(k)["confidence"]))

    def or_else(k: str, value: Column, sure: float) -> tuple[Column, Column]:
        return F.coalesce(F.when(fact(k).isNotNull(), fact(k)["value"]), value), F.when(fact(k).isNotNull(), capped(fact(k)["confidence"])).when(value.isNotNull(), capped(F.lit(sure)))

    def plain(value: Column, sure: Column | float) -> tuple[Column, Column]:
        return value, capped(F.lit(sure) if isinstance(sure, float) else sure)

    seen = lambda kind: F.array_contains("present", kind)
    score = lambda k: (F.when(c(k).isNotNull(), clamp(c(k))), capped(F.try_element_at("score_confidence", F.lit(k))))
    rules = {
        "church_name": plain(c("name"), F.coalesce(F.nullif(c("identity_confidence"), F.lit(0.0)), F.lit(60.0))), "city": plain(c("city"), 60.0), "state": plain(c("state"), 60.0),
        "lead_pastor": plain(F.coalesce("lead_pastor", fact("lead_pastor")["value"]), estimate("lead_pastor")), "lead_pastor_role": (c("role_conflict.value_a"), c("role_conflict.confidence")),
        **{k: of_fact(k) for k in ("executive_pastor", "operations_leader", "communications_leader", "office_email", "office_phone")},
        "denomination": plain(c("denomination"), 65.0), "multi_site": of_fact("multi_site"), "campus_count": of_fact("campus_count"), "lifecycle_stage": plain(c("lifecycle_stage"), estimate("lifecycle_stage")),
        "founded_year": of_fact("founded_year"), "years_active": of_fact("years_active"), "avg_weekly_attendance": (c("attendance"), F.when(c("attendance").isNotNull(), capped(c("attendance_confidence")))),
        "online_attendance_estimate": (c("online_attendance_estimate"), C.cap_confidence(F.coalesce("online_attendance_confidence", F.lit(0.0)), c("access_level"))), "staff_count": of_fact("staff_count"), "annual_budget": (none, none),
        "church_app_status": or_else("app_status", c("app_status"), 60.0), "app_provider": or_else("app_provider", c("app_provider"), 40.0), "livestream_present": plain(seen("youtube") | F.coalesce(c("digital_summary").rlike("(?i)live"), F.lit(False)), 65.0),
        **{f"{k}_present": plain(seen(k), 65.0) for k in ("youtube", "instagram", "facebook")}, **{f"{k}_followers": plain(fact(f"{k}_followers")["value"], 60.0) for k in ("instagram", "facebook")},
        "online_giving_present": of_fact("online_giving_present"), **{k: score(k) for k in ("change_readiness_score", "digital_maturity_score", "growth_orientation_score", "staff_depth_score")},
        "evidence_access_level": (c("access_level"), F.lit(90.0)), "identity_contamination_flag": (F.size("contamination") > 0, F.lit(80.0)),
    }
    rows = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), sure.cast("double").alias("confidence")) for k, (v, sure) in rules.items()))
    return dossiers.select("entity_id", F.posexplode(rows).alias("key_no", "r")).select("entity_id", "key_no", "r.*")
