"""Runs over model answers: evidence, gated updates, reviews, scores and the ledger."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import SETTINGS, Settings
from factloom.functions import confidence as C
from factloom.functions import scoring as S
from factloom.functions import urls as U
from factloom.operators import merge
from factloom.operators.facts import source_urls
from factloom.operators.ranking import first_per
from factloom.operators.schemas import typed


#: What tells answers of one schema apart.
KEYS = ["entity_id", "seq"]


def answer_evidence(answers: DataFrame) -> DataFrame:
    """The evidence of valid answers as rows: entity_id, seq, item_no, field_name, value,
    evidence_text, source_url, source_type, confidence.

    Needs entity_id, seq, official_site and the answer's members ``a``.
    """
    items = answers.select("entity_id", "seq", "official_site", F.posexplode("a.evidence").alias("item_no", "e"))
    return items.select(
        "entity_id", "seq", "item_no", "e.field_name", F.col("e.proposed_value").alias("value"), "e.evidence_text", "e.source_url",
        U.source_type(F.col("e.source_url"), F.col("official_site")).alias("source_type"), C.clamp_confidence(F.col("e.confidence_score")).alias("confidence"),
    )


def _urls(evidence: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(evidence, lambda e: e["source_url"]), lambda u: F.coalesce(u, F.lit("")) != ""))


@dataclass(frozen=True)
class Verification:
    """What a verification gives: all three outputs and the score come from ``proposals``
    and the same valid answers."""

    evidence: DataFrame
    proposals: DataFrame
    patches: DataFrame
    reviews: DataFrame


def verification(answers: DataFrame, entities: DataFrame, settings: Settings = SETTINGS) -> Verification:
    """The verification of entities from answers under the schema of that name.

    answers: entity_id, seq, schema_name, json; entities: id, official_site and the
    fields active_status, website_verified. Each valid answer proposes a status and, if
    it names one, a site. Confident proposals become patches, plausible ones reviews, and
    the rest stays evidence; the score is derived, so it passes no gate. Where an entity
    has several answers the last (seq) wins field by field.
    """
    fields = ["active_status", "website_verified"]
    held = entities.select(F.col("id").alias("entity_id"), "official_site", *(F.col(f).alias(f"held_{f}") for f in fields))
    valid = typed(answers, "verification", KEYS).select("entity_id", "seq", "a").join(held, "entity_id")
    signals = F.when(F.size("a.closure_merger_signals") > 0, F.concat(F.lit(" | signals: "), F.array_join("a.closure_merger_signals", "; "))).otherwise("")

    def one(name: str, summary: Column) -> Column:
        value, sure = F.col(f"a.{name}"), C.clamp_confidence(F.col(f"a.{name}_confidence"))
        return F.struct(F.lit(name).alias("field_name"), value.alias("value"), F.col(f"held_{name}").alias("current_value"), sure.alias("confidence"), merge.apply_proposal(value, sure, settings).alias("decision"), summary.alias("evidence_summary"))

    both = F.array(one("active_status", F.concat("a.reasoning", signals)), one("website_verified", F.lit("Official website identified during verification")))
    told = valid.select("entity_id", "seq", _urls(F.col("a.evidence")).alias("source_urls"), F.explode(both).alias("p"))
    proposals = told.select("entity_id", "seq", "p.*", "source_urls").where(F.coalesce("value", F.lit("")) != "")
    updates = first_per(proposals.where("decision = 'update'"), ["entity_id", "field_name"], [F.desc("seq")])
    score = C.clamp_confidence(S.verification_score(F.col("a.active_status_confidence"), F.col("a.website_verified_confidence")))
    scores = first_per(valid, ["entity_id"], [F.desc("seq")]).select("entity_id", score.alias("verification_score"), F.col("seq").alias("last_checked_at"))
    of = lambda f: F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f)
    patches = scores.join(updates.groupBy("entity_id").agg(*(of(f) for f in fields)), "entity_id", "left")
    return Verification(answer_evidence(valid), proposals, patches.withColumnRenamed("entity_id", "id"), proposals.where("decision = 'review'"))


def multiplication(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Scores of the entities that have a valid multiplication answer, from the last one:
    id and six scores. They are derived, so they pass no gate.

    entities, as they are after earlier runs: id, attendance, campuses, services, staff,
    denomination, network.
    """
    valid = first_per(typed(answers, "multiplication", KEYS), ["entity_id"], [F.desc("seq")]).select(F.col("entity_id").alias("id"), "a")
    a = lambda name: F.col(f"a.{name}")
    inputs = [a("multiplication_orientation"), a("church_planting_activity"), a("leadership_development")]
    complexity = S.complexity_sub_score(F.col("campuses"), F.col("services"), F.col("staff"))
    network = S.network_sub_score(F.col("denomination"), F.col("network"))
    return valid.join(entities, "id").select(
        "id",
        S.multiplication_score(*inputs, a("innovation")).alias("multiplication_score"),
        S.influence_score(S.attendance_sub_score(F.col("attendance")), complexity, a("digital_reach"), network, a("leadership_development")).alias("influence_score"),
        S.fit_score(*inputs, a("kingdom_collaboration"), a("innovation")).alias("fit_score"),
        a("church_planting_activity").alias("planting_activity"),
        a("leadership_development").alias("leadership_score"),
        a("digital_reach").alias("digital_score"),
    )


# Why an entity can't be researched, by what was found of it.
UNREADABLE = "Found a candidate site ({site}) but could not read any pages [crawlMethod={method}]."
NO_RESULTS = "No official website could be identified [crawlMethod={method}]. Web search returned no results (outbound search may be blocked)."
ONLY_LISTINGS = "No official website could be identified [crawlMethod={method}]. Search returned only directory/social links."


def _filled(template: str, **parts: Column) -> Column:
    out = []
    for i, piece in enumerate(template.replace("{", "\0{").replace("}", "}\0").split("\0")):
        if piece:
            out.append(parts[piece[1:-1]] if piece.startswith("{") else F.lit(piece))
    return F.concat(*out)


def research_items(bundles: DataFrame) -> DataFrame:
    """Queue items of the entities of which no page could be read: entity_id, field_name,
    proposed_value, confidence, evidence_summary, source_urls, review_status.

    bundles: entity_id, official_site, crawl_method, note, n_ok_pages, n_results.
    """
    site, method = F.col("official_site"), F.coalesce("crawl_method", F.lit("none"))
    no_site = F.when(F.col("n_results") == 0, _filled(NO_RESULTS, method=method)).otherwise(_filled(ONLY_LISTINGS, method=method))
    found = F.coalesce(site, F.lit("")) != ""
    reason = F.when(found, F.trim(F.concat(_filled(UNREADABLE, site=site, method=method), F.lit(" "), F.coalesce("note", F.lit(""))))).otherwise(no_site)
    return bundles.where("n_ok_pages = 0").select(
        "entity_id", F.lit("research_status").alias("field_name"), F.lit("needs manual research").alias("proposed_value"), F.lit(0.0).alias("confidence"),
        reason.alias("evidence_summary"), source_urls(site).alias("source_urls"), F.lit("pending").alias("review_status"),
    )


def run_entities(requested: DataFrame, bundles: DataFrame, answers: DataFrame) -> DataFrame:
    """The ledger of one run for each requested entity, whatever becomes of the others:
    entity_id, run_type, status, error_message, called, tokens.

    requested: entity_id, run_type; bundles as for ``research_items``; answers, one for
    each entity and run type: entity_id, run_type, problem and path of its first violation
    (null if it is valid), tokens. A verification asks the model only where pages or
    results were found, other runs always. An entity without a bundle isn't known: its
    run fails, as does one whose answer is missing or has a problem.
    """
    known = requested.join(bundles.select("entity_id", "n_ok_pages", "n_results"), "entity_id", "left")
    answers = answers.withColumn("answered", F.lit(True))
    all_ = known.join(answers, ["entity_id", "run_type"], "left")
    there = F.col("n_ok_pages").isNotNull()
    called = there & ((F.col("run_type") != "verify") | (F.col("n_ok_pages") > 0) | (F.col("n_results") > 0))
    wrong = F.concat_ws(" ", "problem", F.lit("at"), F.when(F.col("path") == "", "the root").otherwise(F.col("path")))
    error = F.when(~there, F.concat(F.lit("entity "), F.col("entity_id").cast("string"), F.lit(" not found")))
    error = error.when(called & F.col("answered").isNull(), F.lit("no answer")).when(called & F.col("problem").isNotNull(), wrong)
    return all_.select("entity_id", "run_type", F.when(error.isNull(), "completed").otherwise("failed").alias("status"), error.alias("error_message"), called.alias("called"), F.when(called, F.coalesce("tokens", F.lit(0))).otherwise(0).cast("long").alias("tokens"))
