"""Findings and structured fields from pages and snippets, and the dossier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.functions import extract as X
from factloom.functions import html as H
from factloom.functions import urls as U
from factloom.functions.extract import role_of_title
from factloom.operators import coverage, facts
from factloom.operators.ranking import first_per
from factloom.operators.staff import cards_column


def _field(name: str, value: Column, confidence: float) -> Column:
    return F.struct(F.lit(name).alias("field_name"), value.cast("string").alias("value"), F.lit(float(confidence)).alias("confidence"))


def website_findings(pages: DataFrame) -> DataFrame:
    """One finding per page of the own site that could be read, with its fields;
    cards of staff pages give roles, a head count and text.

    pages: entity_id, seq, url, status, category, html.
    """
    ok = pages.where(F.col("status").between(200, 299)).withColumns({"body": H.visible_text(F.col("html")), "found": H.links(F.col("html"))})
    c = F.col("category")
    lines = F.when(c.isin("staff", "leadership"), H.inner_text(F.col("html")))
    ok = ok.withColumn("cards", cards_column(lines))
    said = F.array_join(F.transform("cards", lambda x: F.concat(x["name"], F.lit(" — "), x["title"])), " • ")
    text = F.when(F.size("cards") > 0, F.concat("body", F.lit("\n\nSTAFF CARDS: "), said)).otherwise(F.col("body"))

    def role(card: Column) -> Column:
        kind = role_of_title(card["title"])
        return F.struct(kind["role_field"].alias("field_name"), F.when(kind.isNotNull(), card["name"]).alias("value"), kind["role_confidence"].alias("confidence"))

    phone = F.when(c.isin("contact", "home"), X.phone(F.col("body")))
    title = F.when(c.isin("staff", "leadership"), X.found(F.col("body"), r"(?i)(\b(?:lead|senior|associate|executive|founding)\s+pastor\b)"))
    each = lambda name, values, conf: F.transform(values, lambda v: _field(name, v, conf))
    fields = F.concat(
        F.array(_field("phone", phone, 80), _field("lead_pastor_title_mention", title, 70)),
        each("social_link", H.social_links(F.col("body")), 75),
        each("email", H.addresses(F.col("found"), "mailto"), 88),
        each("phone", H.addresses(F.col("found"), "tel"), 85),
        F.transform("cards", role),
        F.array(_field("staff_count", F.when(F.size("cards") > 0, F.size("cards")), 70)),
    )
    return ok.select(
        "entity_id", "seq", "url", H.title(F.col("html")).alias("title"), text.alias("body"), c.alias("category"), H.source_type_of_category(c).alias("source_type"),
        F.lit("live_official_site").alias("access_level"), F.lit(0.95).alias("reliability"), F.lit(True).alias("fetched"), F.length("body").alias("text_length"),
        F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != "").alias("fields"),
    )


def snippet_findings(results: DataFrame) -> DataFrame:
    """One finding per URL of an entity's search results, from the first of its repeats.

    results: entity_id, seq, url, title, snippet, official_host.
    """
    kind = U.classify_result(F.col("url"), F.col("official_host"))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("snippet", F.lit("")))
    rows = first_per(results, ["entity_id", "url"], [F.asc("seq")]).withColumns({"kind": kind, "text": text})
    return rows.select(
        "entity_id", "seq", "url", "title", F.col("snippet").alias("body"), F.lit(None).cast("string").alias("category"), "kind.source_type", "kind.access_level", "kind.reliability",
        F.lit(False).alias("fetched"), F.length("snippet").alias("text_length"), X.snippet_facts(F.col("kind.source_type"), F.col("text")).alias("fields"),
    )


def fact_candidates(findings: DataFrame, as_of: int = 2024) -> DataFrame:
    """Candidates of all findings, from their text and from their fields."""
    text = F.trim(F.regexp_replace(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit(""))), r"\s+", " "))
    common = ["entity_id", "url", "access_level", "reliability"]
    read = X.text_facts(findings.where(text != "").withColumn("seq", F.col("seq") * 2), [*common, "seq"], text, F.col("url"), as_of)
    told = facts.structured_candidates(findings.where(text != "").select(*common, (F.col("seq") * 2 + 1).alias("seq"), F.inline("fields")))
    return read.unionByName(told)


def dossiers(findings: DataFrame, as_of: int = 2024) -> DataFrame:
    """Per entity: access level, source counts, conflicts, confidence in the
    research, number of facts, digital signals and the best contact facts."""
    stats = facts.source_statistics(findings)
    fields = findings.select("entity_id", "seq", "access_level", "reliability", F.inline("fields"))
    keyed = fields.withColumn("norm", facts.norm_for_conflict(F.col("field_name"), F.col("value"))).where("norm is not null")
    clash = facts.conflicts(keyed.withColumnRenamed("field_name", "key")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_conflicts"))
    best = facts.best_facts(fact_candidates(findings, as_of))
    of = lambda name: F.max(F.when(F.col("field_name") == name, F.col("value"))).alias(name)
    known = best.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_facts"), of("office_email"), of("office_phone"), of("lead_pastor"), of("founded_year"))
    signals = coverage.signals_by_entity(findings).select("entity_id", "signals_detected")
    wide = stats.join(clash, "entity_id", "left").join(known, "entity_id", "left").join(signals, "entity_id", "left").withColumn("n_conflicts", F.coalesce("n_conflicts", F.lit(0)))
    score = facts.research_confidence(F.col("source_types"), F.col("official_crawled"), F.col("source_count"), F.col("n_conflicts"), F.col("access_level"))
    return wide.withColumn("research_confidence", score).withColumn("tier", C.confidence_tier(F.col("research_confidence")))
