"""From an entity's research result to proposals for its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.operators.facts import source_urls


def field_proposals(build: DataFrame) -> DataFrame:
    """Proposals in order of their fields: entity_id, field_no, field_name, value,
    confidence, is_contact, evidence_text, source_urls, access_level.

    build, a row for each entity: identity_verdict, identity_site, identity_confidence,
    method, official_site, official_crawled, research_confidence, access_level,
    denomination, lead_pastor (of the synthesis); facts, a map from fact to (value,
    confidence, source_url); estimates, a map from field to the highest confidence
    of its estimates. The site counts on a sure match only, the status only if the
    site was read. A proposal without value or confidence is left out.
    """
    c, of = F.col, lambda f: F.col("facts")[f]
    estimate = lambda f: F.col("estimates")[f]

    def one(name: str, value: Column, confidence: Column, contact: bool, text: Column, *urls: Column) -> Column:
        return F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence"), F.lit(contact).alias("is_contact"), text.alias("evidence_text"), source_urls(*urls).alias("source_urls"))

    def of_fact(name: str, fact: str, contact: bool, text: str) -> Column:
        sure = F.when(of(fact).isNotNull(), F.coalesce(estimate(fact), of(fact)["confidence"]))
        return one(name, of(fact)["value"], sure, contact, F.lit(text), of(fact)["source_url"])

    match = (c("identity_verdict") == "true_match") & (F.coalesce("identity_site", F.lit("")) != "")
    rows = F.array(
        one("website_verified", F.when(match, c("identity_site")), c("identity_confidence"), False, F.concat(F.lit("Identity-verified official site ("), c("method"), F.lit(")")), c("identity_site")),
        one("active_status", F.when(c("official_crawled"), F.lit("Verified Active")), c("research_confidence"), False, F.lit("Official website is live and reachable"), c("official_site")),
        one("denomination", c("denomination"), F.coalesce(estimate("denomination"), C.cap_confidence(F.lit(65.0), c("access_level"))), False, F.lit("Denomination from dossier synthesis"), c("official_site")),
        one("lead_pastor", F.coalesce("lead_pastor", of("lead_pastor")["value"]), estimate("lead_pastor"), True, F.lit("Lead pastor (contact)"), of("lead_pastor")["source_url"], c("official_site")),
        of_fact("email_verified", "office_email", True, "Public office email"),
        of_fact("phone_verified", "office_phone", True, "Public office phone"),
        of_fact("staff_count", "staff_count", False, "Staff count"),
        of_fact("campus_count", "campus_count", False, "Campus count"),
    )
    out = build.select("entity_id", "access_level", F.posexplode(rows).alias("field_no", "p")).select("entity_id", "field_no", "p.*", "access_level")
    return out.where((F.coalesce("value", F.lit("")) != "") & F.col("confidence").isNotNull())


def attendance_proposals(build: DataFrame) -> DataFrame:
    """The attendance estimate with its range, confidence and tier, and what becomes
    of it by its own gate; entities without estimate and range have none.

    build: entity_id, attendance, attendance_min, attendance_max,
    attendance_confidence, access_level."""
    a, low, high = (F.col(x).cast("long").cast("string") for x in ("attendance", "attendance_min", "attendance_max"))
    whole = build.where(F.col("attendance").isNotNull() & F.col("attendance_min").isNotNull() & F.col("attendance_max").isNotNull())
    conf = C.cap_confidence(F.coalesce("attendance_confidence", F.lit(0.0)), F.col("access_level"))
    tier, shown = C.confidence_tier(F.col("confidence")), F.col("confidence").cast("long").cast("string")
    text = F.concat(F.lit("Attendance estimate "), a, F.lit(" ["), low, F.lit("–"), high, F.lit("], tier "), F.col("tier"), F.lit(", confidence "), shown, F.lit(" (access "), F.col("access_level"), F.lit(")."))
    return (
        whole.withColumn("confidence", conf)
        .withColumns({"tier": tier, "decision": C.decide_update(F.col("confidence")), "value": F.concat(a, F.lit(" ["), low, F.lit("-"), high, F.lit("]"))})
        .select("entity_id", F.lit("attendance_estimate").alias("field_name"), "value", "confidence", "tier", "decision", text.alias("evidence_text"))
    )


def write_metadata(entities: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """Entities with the research columns of their result, nulls included where there
    is one; these are no claims about the entity and pass no gate."""
    joined = entities.alias("e").join(results.select("id", *columns, F.lit(True).alias("there")).alias("r"), "id", "left")
    return joined.select(*(F.when(F.col("r.there"), F.col(f"r.{c}")).otherwise(F.col(f"e.{c}")).alias(c) if c in columns else (F.col("id") if c == "id" else F.col(f"e.{c}")) for c in entities.columns))
