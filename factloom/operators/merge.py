"""Gated merge of proposals into the master table, and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.config import NUMERIC_FIELDS, SETTINGS, Settings
from factloom.functions import confidence as C
from factloom.operators.ranking import first_per


def best_evidence(evidence: DataFrame) -> DataFrame:
    """Highest confidence on record per entity and field; a null counts as 0."""
    return evidence.groupBy("entity_id", "field_name").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("existing_confidence"))


def merge_decisions(proposals: DataFrame, evidence: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """What becomes of each proposal: update, review, evidence_only or skipped.

    A proposal is recorded as evidence before the confidence on record is read, so
    that is never below its own; hence a value that is there already is never
    overwritten without review. ``prior_confidence`` is what was on record before.

    Needs entity_id, field_name, value, current_value, confidence, access_level,
    is_contact. Proposals without a value or a confidence are left out.
    """
    capped = C.cap_confidence(F.col("confidence"), F.col("access_level"))
    usable = proposals.where(F.col("value").isNotNull() & (F.col("value") != "") & F.col("confidence").isNotNull()).withColumn("confidence", capped)
    known = usable.join(best_evidence(evidence).withColumnRenamed("existing_confidence", "prior_confidence"), ["entity_id", "field_name"], "left")
    existing = F.greatest("prior_confidence", "confidence")
    held = F.coalesce(F.col("current_value"), F.lit("")) != ""
    gate = C.decide_update(F.col("confidence"), settings)
    gate = F.when(F.col("is_contact") & (gate == "update") & (F.col("confidence") < settings.contact_auto_min), "review").otherwise(gate)
    gate = F.when((gate == "update") & held & (F.col("confidence") < existing + 1), "review").otherwise(gate)
    return known.withColumns({"existing_confidence": existing, "decision": F.when(held & (existing > F.col("confidence")), "skipped").otherwise(gate)})


def apply_proposal(value: Column, score: Column, settings: Settings = SETTINGS) -> Column:
    """Gate of one proposal outside the dossier: nothing concrete is evidence only."""
    gate = C.decide_update(C.clamp_confidence(score), settings)
    return F.when(value.isNull() | (value == ""), "evidence_only").otherwise(gate)


def update_rows(entities: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Entities with the non-null columns of their patch; at most one patch each."""
    columns = [c for c in patches.columns if c != key]
    joined = entities.alias("e").join(patches.alias("p"), key, "left")
    return joined.select(*(F.coalesce(f"p.{c}", f"e.{c}").alias(c) if c in columns else F.col(key if c == key else f"e.{c}") for c in entities.columns))


def insert_absent(existing: DataFrame, incoming: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Incoming rows whose key is new, the first of each key; rows that are there
    stay as they are."""
    return first_per(incoming, [key], order).join(existing.select(key), key, "left_anti")


def enqueue_reviews(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """Queue after the incoming items: one pending item per entity and field, which
    a new one overwrites but for its id and creation time.

    Both need id, entity_id, field_name, proposed_value, confidence,
    review_status, created_at; incoming also seq, the last of which wins.
    """
    keys = ["entity_id", "field_name"]
    latest = first_per(incoming, keys, [F.desc("seq")])
    pending, rest = queue.where("review_status = 'pending'"), queue.where("review_status <> 'pending'")
    both = pending.alias("o").join(latest.alias("n"), keys, "full_outer")
    merged = both.select(
        F.coalesce("o.id", "n.id").alias("id"),
        *keys,
        F.coalesce("n.proposed_value", "o.proposed_value").alias("proposed_value"),
        F.coalesce("n.confidence", "o.confidence").alias("confidence"),
        F.lit("pending").alias("review_status"),
        F.coalesce("o.created_at", "n.created_at").alias("created_at"),
    )
    return rest.select(*merged.columns).unionByName(merged)


def coerced(field: Column, value: Column) -> Column:
    """Value of a review as it is written: text that is no number is null in a
    numeric field."""
    return F.when(field.isin(NUMERIC_FIELDS), value.try_cast("double").cast("string")).otherwise(value)


def apply_reviews(queue: DataFrame) -> DataFrame:
    """Value per entity and field after all approved items are applied.

    They are applied from high to low confidence (null last), so the one that
    stays is the lowest, and of equal ones the latest (seq).
    """
    approved = queue.where("review_status = 'approved'")
    last = first_per(approved, ["entity_id", "field_name"], [F.asc_nulls_first("confidence"), F.desc("seq")])
    return last.withColumn("applied_value", coerced(F.col("field_name"), F.col("proposed_value")))


def review_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(
        *(F.count_if(F.col("review_status") == s).alias(n) for s, n in (("pending", "pending"), ("approved", "approved_applied"), ("rejected", "rejected"), ("needs_more_research", "needs_more_research")))
    )


def last_write(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key; rows with a null key are all kept."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return first_per(rows.where(whole), keys, [F.desc(order)]).unionByName(rows.where(~whole))


def patch_reviews(queue: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """Queue with the decisions (id, review_status) and the time they were made."""
    made = decisions.select("id", F.col("review_status").alias("decided"))
    decided = F.col("decided").isNotNull()
    return (
        queue.join(made, "id", "left")
        .withColumns({"review_status": F.coalesce("decided", "review_status"), "reviewed_at": F.when(decided, as_of)})
        .drop("decided")
    )
