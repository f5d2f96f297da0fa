"""Registered queries on whole dossiers and their export as fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import apply, dossier, facts
from factloom.plans.catalogue import CAP, RANK, _capped, registered
from factloom.sources.fixtures import view

_VIEWS = ("dossier_entities", "dossier_facts", "dossier_sites", "dossier_roles", "findings")
_LEVELS = ["vendor_reference", "search_snippets", "third_party_directory", "job_posting", "social_profile", "staff_profile", "live_official_site", "user_provided_ground_truth"]
DOSSIER_SQL = f"""
, stats AS (SELECT entity_id, [{', '.join(f"'{x}'" for x in _LEVELS)}][CAST(max({RANK}) + 1 AS BIGINT)] AS access_level, bool_or(access_level = 'live_official_site' AND fetched) AS official_crawled, count(DISTINCT source_type) AS types, count(*) AS n, list(DISTINCT source_type) AS present FROM findings GROUP BY 1),
tops AS (SELECT *, first_value(norm) OVER w AS top, row_number() OVER w AS pos FROM dossier_roles WINDOW w AS (PARTITION BY entity_id ORDER BY reliability DESC, seq)),
clash AS (SELECT entity_id, value AS role, {_capped('60')} AS role_confidence FROM tops WHERE pos = 1 AND entity_id IN (SELECT entity_id FROM tops WHERE norm <> top)),
flags AS (SELECT entity_id, string_agg(f, ' ' ORDER BY f) AS contamination FROM (SELECT DISTINCT entity_id, 'Same-name church at ' || host || ' appears to be in a different city/state (' || url || ') — not this church; do not attribute its facts here.' AS f
          FROM dossier_sites WHERE name_full AND place = 'conflict' AND (kind = 'official' OR source = 'search')) GROUP BY 1),
wide AS (SELECT *, CASE WHEN r.role IS NULL THEN 0 ELSE 1 END AS n_conflicts, {CAP} AS cap FROM dossier_entities e JOIN stats USING (entity_id) LEFT JOIN clash r USING (entity_id) LEFT JOIN flags USING (entity_id)),
whole AS (SELECT *, CAST(greatest(0, least(cap, floor(greatest(0, least(100, least(types / 8, 1) * 55 + CASE WHEN official_crawled THEN 25 ELSE 0 END + CASE WHEN n >= 5 THEN 15 ELSE 5 END - n_conflicts * 4)) + 0.5))) AS DOUBLE) AS research_confidence FROM wide),
best AS (SELECT entity_id, field_name, value, confidence, source_url, access_level FROM dossier_facts QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY reliability * confidence DESC, seq) = 1),
merged AS (SELECT *, 'extracted' AS origin FROM best
  UNION ALL SELECT entity_id, 'staff_count', CAST(staff_count AS VARCHAR), CASE staff_count_confidence WHEN 0 THEN 40 ELSE staff_count_confidence END, coalesce(official_site, ''), access_level, 'synthesis' FROM whole WHERE staff_count IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM best WHERE field_name = 'staff_count')
  UNION ALL SELECT entity_id, 'campus_count', CAST(campus_count AS VARCHAR), 40, coalesce(official_site, ''), access_level, 'synthesis' FROM whole WHERE campus_count IS NOT NULL AND entity_id NOT IN (SELECT entity_id FROM best WHERE field_name = 'campus_count'))
"""  # fmt: skip


def _dossiers(spark, sf):
    rows = [view(spark, sf, v) for v in _VIEWS]
    best = facts.best_facts(rows[1]).select("entity_id", "field_name", "value", "confidence", "source_url", "access_level")
    return dossier.build(rows[0], rows[4], best, facts.conflicts(rows[3]), rows[2])


@registered(DOSSIER_SQL + "SELECT entity_id, field_name, value, CAST(confidence AS DOUBLE) AS confidence, source_url, access_level, origin FROM merged", *_VIEWS)
def dossier_facts(spark, sf):
    """The facts of the whole dossiers, each with where it comes from."""
    d = _dossiers(spark, sf).select("entity_id", F.explode("facts").alias("field_name", "f"))
    return d.select("entity_id", "field_name", "f.*")


@registered(DOSSIER_SQL + f"""
SELECT entity_id AS id, lifecycle_stage, greatest(0, least(100, growth_orientation_score)) AS growth_orientation_score, digital_maturity_score, change_readiness_score, least(100, staff_depth_score) AS staff_depth_score, access_level AS evidence_access_level,
    contamination IS NOT NULL AS identity_contamination_flag, research_confidence, app_status, app_provider, online_attendance_estimate, {_capped('online_attendance_confidence', 'cap')} AS online_attendance_confidence FROM whole
""".replace("greatest(0, least(100, growth_orientation_score)) AS", "CASE WHEN growth_orientation_score IS NOT NULL THEN greatest(0, least(100, growth_orientation_score)) END AS"), *_VIEWS)  # fmt: skip
def dossier_metadata(spark, sf):
    return dossier.metadata(_dossiers(spark, sf))



def _of_fact(k: str) -> tuple[str, str]:
    return f"f_{k}", f"CASE WHEN f_{k} IS NOT NULL THEN least(c_{k}, cap) END"


def _score(k: str) -> tuple[str, str]:
    return f"CASE WHEN {k} IS NOT NULL THEN CAST(greatest(0, least(100, {k})) AS DOUBLE) END", "least(CAST(50 + entity_id % 40 AS DOUBLE), cap)" if k == "growth_orientation_score" else "cap"


_KEYS = {
    "church_name": ("name", "least(CASE identity_confidence WHEN 0 THEN 60 ELSE identity_confidence END, cap)"), "city": ("city", "least(60, cap)"), "state": ("state", "least(60, cap)"),
    "lead_pastor": ("coalesce(lead_pastor, f_lead_pastor)", "CASE WHEN f_lead_pastor IS NULL THEN cap ELSE least(e_lead_pastor, cap) END"), "lead_pastor_role": ("role", "role_confidence"),
    **{k: _of_fact(k) for k in ("executive_pastor", "operations_leader", "communications_leader", "office_email", "office_phone")}, "denomination": ("denomination", "least(65, cap)"), "multi_site": _of_fact("multi_site"), "campus_count": _of_fact("campus_count"),
    "lifecycle_stage": ("lifecycle_stage", "cap"), "founded_year": _of_fact("founded_year"), "years_active": _of_fact("years_active"), "avg_weekly_attendance": ("attendance", "CASE WHEN attendance IS NOT NULL THEN least(attendance_confidence, cap) END"),
    "online_attendance_estimate": ("online_attendance_estimate", _capped("online_attendance_confidence", "cap")), "staff_count": _of_fact("staff_count"), "annual_budget": ("NULL", "NULL"),
    "church_app_status": ("app_status", "least(60, cap)"), "app_provider": ("coalesce(f_app_provider, app_provider)", "CASE WHEN f_app_provider IS NOT NULL THEN least(c_app_provider, cap) WHEN app_provider IS NOT NULL THEN least(40, cap) END"),
    "livestream_present": ("list_contains(present, 'youtube') OR contains(lower(digital_summary), 'live')", "least(65, cap)"), **{f"{k}_present": (f"list_contains(present, '{k}')", "least(65, cap)") for k in ("youtube", "instagram", "facebook")},
    "instagram_followers": ("f_instagram_followers", "least(60, cap)"), "facebook_followers": ("NULL", "least(60, cap)"), "online_giving_present": _of_fact("online_giving_present"),
    **{k: _score(k) for k in ("change_readiness_score", "digital_maturity_score", "growth_orientation_score", "staff_depth_score")}, "evidence_access_level": ("access_level", "90"), "identity_contamination_flag": ("contamination IS NOT NULL", "80"),
}
_NAMES = ["lead_pastor", "executive_pastor", "operations_leader", "communications_leader", "office_email", "office_phone", "multi_site", "campus_count", "founded_year", "years_active", "staff_count", "app_provider", "instagram_followers", "online_giving_present"]
_FLAT = ", ".join(f"max(CASE WHEN field_name = '{k}' THEN value END) AS f_{k}, max(CASE WHEN field_name = '{k}' THEN confidence END) AS c_{k}, max(CASE WHEN field_name = '{k}' THEN {_capped('confidence')} END) AS e_{k}, max(CASE WHEN field_name = '{k}' THEN source_url END) AS u_{k}" for k in _NAMES)


@registered(DOSSIER_SQL + f", flat AS (SELECT entity_id, {_FLAT} FROM merged GROUP BY 1), joined AS (SELECT * FROM whole LEFT JOIN flat USING (entity_id))" + " UNION ALL ".join(
    f"SELECT entity_id, CAST({i} AS INTEGER) AS key_no, '{k}' AS key, CAST({v} AS VARCHAR) AS value, CAST({c} AS DOUBLE) AS confidence FROM joined" for i, (k, (v, c)) in enumerate(_KEYS.items())), *_VIEWS)
def dossier_export(spark, sf):
    """The 35 fields of every dossier."""
    scores = F.create_map(F.lit("growth_orientation_score"), (50 + F.col("entity_id") % 40).cast("double"))
    return dossier.export_fields(_dossiers(spark, sf).withColumn("score_confidence", scores))


_PROPOSED = [
    ("website_verified", "CASE WHEN identity_verdict = 'true_match' THEN identity_site END", "identity_confidence", "false", "Identity-verified official site (search)", "identity_site", "NULL"),
    ("active_status", "CASE WHEN official_crawled THEN 'Verified Active' END", "research_confidence", "false", "Official website is live and reachable", "official_site", "NULL"),
    ("denomination", "denomination", _capped("65", "cap"), "false", "Denomination from dossier synthesis", "official_site", "NULL"),
    ("lead_pastor", "coalesce(lead_pastor, f_lead_pastor)", "e_lead_pastor", "true", "Lead pastor (contact)", "u_lead_pastor", "official_site"),
    *((n, f"f_{k}", f"e_{k}", c, t, f"u_{k}", "NULL") for n, k, c, t in (("email_verified", "office_email", "true", "Public office email"), ("phone_verified", "office_phone", "true", "Public office phone"), ("staff_count", "staff_count", "false", "Staff count"), ("campus_count", "campus_count", "false", "Campus count"))),
]


@registered(DOSSIER_SQL + f", flat AS (SELECT entity_id, {_FLAT} FROM merged GROUP BY 1), joined AS (SELECT * FROM whole LEFT JOIN flat USING (entity_id)), made AS (" + " UNION ALL ".join(
    f"SELECT entity_id, CAST({i} AS INTEGER) AS field_no, '{n}' AS field_name, {v} AS value, CAST({c} AS DOUBLE) AS confidence, {contact} AS is_contact, '{text}' AS evidence_text, concat_ws(' ', nullif({a}, ''), CASE WHEN {b} IS DISTINCT FROM {a} THEN nullif({b}, '') END) AS source_urls, access_level FROM joined"
    for i, (n, v, c, contact, text, a, b) in enumerate(_PROPOSED)) + ") SELECT * FROM made WHERE coalesce(value, '') <> '' AND confidence IS NOT NULL", *_VIEWS)
def dossier_whole_proposals(spark, sf):
    """What the whole dossiers propose for their entities' fields."""
    return apply.field_proposals(_dossiers(spark, sf)).withColumn("source_urls", F.array_join("source_urls", " "))
