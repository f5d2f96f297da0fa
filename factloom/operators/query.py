"""Filter, search, sort and page over entities, and their look-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EntityFilter:
    """Conjunction of what is set. An empty value counts as missing; ``search`` is
    a literal part of the name, in any case."""

    state: str | None = None
    active_status: str | None = None
    missing_website: bool = False
    missing_email: bool = False
    missing_lead: bool = False
    needs_verification: bool = False
    min_fit: float | None = None
    search: str | None = None
    limit: int | None = None
    offset: int | None = None

    @classmethod
    def from_query(cls, params: dict[str, str]) -> EntityFilter:
        """From the parameters of a request; 100 rows from the first by default."""
        flag = lambda k: params.get(k) in ("1", "true")
        return cls(
            params.get("state") or None, params.get("active_status") or None, flag("missing_website"), flag("missing_email"), flag("missing_lead"), flag("needs_verification"),
            float(params["min_fit"]) if params.get("min_fit") else None, params.get("search") or None, int(params.get("limit") or 100), int(params.get("offset") or 0),
        )


def missing(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


def filter_entities(entities: DataFrame, f: EntityFilter) -> DataFrame:
    out = entities
    if f.state:
        out = out.where(F.col("state") == f.state)
    if f.active_status:
        out = out.where(F.col("active_status") == f.active_status)
    for wanted, name in ((f.missing_website, "website"), (f.missing_email, "email"), (f.missing_lead, "lead_name")):
        if wanted:
            out = out.where(missing(name))
    if f.needs_verification:
        out = out.where(F.col("last_checked_at").isNull())
    if f.min_fit is not None:
        out = out.where(F.col("fit_score") >= f.min_fit)
    if f.search:
        out = out.where(F.lower("name").contains(f.search.lower()))
    return out


def list_entities(entities: DataFrame, f: EntityFilter) -> DataFrame:
    """Best fit first, null last, then by id. An offset needs a limit."""
    out = filter_entities(entities, f).orderBy(F.desc_nulls_last("fit_score"), F.asc("id"))
    return out.offset(f.offset or 0).limit(f.limit) if f.limit else out


def count_entities(entities: DataFrame, f: EntityFilter) -> DataFrame:
    return filter_entities(entities, f).agg(F.count(F.lit(1)).alias("n"))


def missing_contact(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("website").isNull() | F.col("email").isNull() | F.col("lead_name").isNull())


def high_fit(entities: DataFrame) -> DataFrame:
    """Entities with a score, the best first."""
    return entities.where(F.col("fit_score").isNotNull()).orderBy(F.desc("fit_score"), F.asc("id"))


def next_batch(entities: DataFrame, n: int, missing_website: bool = False) -> DataFrame:
    """The n best entities that wait for verification, or for a site."""
    wanted = EntityFilter(missing_website=True, limit=n) if missing_website else EntityFilter(needs_verification=True, limit=n)
    return list_entities(entities, wanted)


def list_evidence(evidence: DataFrame, entity_id: object = None, field_name: str | None = None) -> DataFrame:
    """Evidence of an entity, of a field, or both, or all; the latest check first,
    rows that were never checked last."""
    out = evidence
    if entity_id is not None:
        out = out.where(F.col("entity_id") == F.lit(entity_id))
    if field_name is not None:
        out = out.where(F.col("field_name") == field_name)
    return out.orderBy(F.desc_nulls_last("checked_at"), F.asc("seq"))


def list_reviews(queue: DataFrame, status: str | None = None) -> DataFrame:
    """Reviews of a status, or all; the surest first, null confidence last."""
    out = queue.where(F.col("review_status") == status) if status else queue
    return out.orderBy(F.desc_nulls_last("confidence"), F.asc("id"))


def list_conflicts(conflicts: DataFrame, entity_id: object = None) -> DataFrame:
    """Conflicts of an entity, or all; the latest first."""
    out = conflicts if entity_id is None else conflicts.where(F.col("entity_id") == F.lit(entity_id))
    return out.orderBy(F.desc("created_at"), F.asc("id"))


def children_of(rows: DataFrame, parents: DataFrame, key: str = "entity_id") -> DataFrame:
    """Rows whose parent is there: what stays when parents are deleted."""
    return rows.join(parents.select(F.col("id").alias(key)), key, "left_semi")


def resolve_ids(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of references that are natural keys (row-...) or ids; ``wanted`` has ref.
    A reference that is neither has a null id."""
    natural = wanted.where(F.startswith("ref", F.lit("row-"))).join(entities.select("id", F.col("original_row_id").alias("ref")), "ref", "left")
    direct = wanted.where(~F.startswith("ref", F.lit("row-"))).join(entities.select("id", F.col("id").cast("string").alias("ref")), "ref", "left")
    return natural.unionByName(direct)


def entity_detail(entities: DataFrame, evidence: DataFrame, order: str = "seq") -> DataFrame:
    """Each entity with its evidence by field, in order."""
    item = F.struct(order, "field_name", "value", "confidence")
    return entities.join(evidence.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("evidence")), "id", "left")
