"""Registered queries on records: listings, the run ledger, conflicts, reviews,
proposals from research results, and the texts that are asked with."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import identity as I
from factloom.operators import apply, coverage, facts, merge, query, report, texts
from factloom.plans.catalogue import SQL, _capped, _gate, _records, registered
from factloom.sources.fixtures import view


def _evidence(spark, sf):
    return view(spark, sf, "evidence").withColumn("checked_at", F.when(F.col("seq") % 4 != 0, F.col("seq")))


@registered("SELECT *, CASE WHEN seq % 4 <> 0 THEN seq END AS checked_at FROM evidence WHERE field_name = '1-URGENT' ORDER BY checked_at DESC NULLS LAST, seq", "evidence")
def evidence_by_field(spark, sf):
    return query.list_evidence(_evidence(spark, sf), field_name="1-URGENT")


@registered("SELECT * FROM queue WHERE review_status = 'pending' ORDER BY confidence DESC NULLS LAST, id", "queue")
def reviews_by_status(spark, sf):
    return query.list_reviews(view(spark, sf, "queue"), "pending")


@registered("SELECT * FROM entities WHERE last_checked_at IS NULL ORDER BY fit_score DESC NULLS LAST, id LIMIT 50", "entities")
def batch_to_verify(spark, sf):
    return query.next_batch(view(spark, sf, "entities"), 50)


@registered("SELECT * FROM entities WHERE coalesce(website, '') = '' ORDER BY fit_score DESC NULLS LAST, id LIMIT 25", "entities")
def batch_without_site(spark, sf):
    return query.next_batch(view(spark, sf, "entities"), 25, missing_website=True)


@registered("SELECT * FROM evidence WHERE entity_id IN (SELECT id FROM entities WHERE active_status <> 'Closed')", "evidence", "entities")
def cascade_evidence(spark, sf):
    return query.children_of(view(spark, sf, "evidence"), view(spark, sf, "entities").where("active_status <> 'Closed'"))


_CONFLICT_LOG = """
, led AS (SELECT *, first_value(value) OVER w AS top, row_number() OVER w AS pos FROM fields WINDOW w AS (PARTITION BY entity_id ORDER BY reliability DESC, seq)),
b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS r FROM led WHERE value <> top)
SELECT md5(CAST(a.entity_id AS STRING) || '|' || a.key || '|' || a.value || '|' || b.value) AS id, a.entity_id, a.key AS field_name, a.value AS value_a, b.value AS value_b, a.value AS recommended_value,
       CAST(least(CASE a.access_level WHEN 'live_official_site' THEN 95 WHEN 'staff_profile' THEN 75 ELSE 65 END, 60) AS DOUBLE) AS confidence, 'open' AS status, CAST(a.entity_id % 1000 AS INT) AS created_at
FROM led a JOIN b USING (entity_id) WHERE a.pos = 1 AND b.r = 1 ORDER BY created_at DESC, id
"""


@registered(_CONFLICT_LOG, "fields")
def conflict_log(spark, sf):
    rows = view(spark, sf, "fields")
    found = facts.conflicts(rows.withColumn("norm", facts.norm_for_conflict(F.col("key"), F.col("value"))))
    return query.list_conflicts(facts.conflict_records(found, (F.col("entity_id") % 1000).cast("int")))


@registered("""
, last AS (SELECT * FROM run_ends QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY completed_at DESC) = 1)
SELECT run_id, entity_id, run_type, CASE WHEN completed_at IS NULL THEN 'running' WHEN error_message IS NOT NULL THEN 'failed' ELSE 'completed' END AS status, 'model-a' AS model_used, started_at, completed_at, error_message,
       tokens_in + tokens_out AS tokens_used, CAST(floor((tokens_in / 1e6 * 3.0 + tokens_out / 1e6 * 15.0) * 1e4 + 0.5) / 1e4 AS DOUBLE) AS cost_estimate
FROM run_starts LEFT JOIN last USING (run_id)
""", "run_starts", "run_ends")  # fmt: skip
def run_ledger(spark, sf):
    return report.close_runs(report.open_runs(view(spark, sf, "run_starts"), "model-a"), view(spark, sf, "run_ends"))


@registered("""
SELECT id, entity_id, field_name, proposed_value, confidence, CASE WHEN review_status = 'pending' AND id % 3 = 0 THEN 'approved' WHEN review_status = 'pending' AND id % 3 = 1 THEN 'rejected' ELSE review_status END AS review_status, seq,
       CASE WHEN review_status = 'pending' AND id % 3 <> 2 THEN 20240501 END AS reviewed_at FROM queue
""", "queue")  # fmt: skip
def review_patch(spark, sf):
    q = view(spark, sf, "queue")
    made = q.where("review_status = 'pending' and id % 3 <> 2").select("id", F.when(F.col("id") % 3 == 0, "approved").otherwise("rejected").alias("review_status"))
    return merge.patch_reviews(q, made, F.lit(20240501))


@registered("""
, u AS (SELECT entity_id, list_filter([f_url, official_site, identity_site, official_site], lambda x: x IS NOT NULL AND x <> '') AS us FROM builds)
SELECT entity_id, array_to_string(list_filter(us, lambda x, i: list_position(us, x) = i), ' ') AS urls FROM u
""", "builds")  # fmt: skip
def distinct_source_urls(spark, sf):
    c = F.col
    return view(spark, sf, "builds").select("entity_id", F.array_join(facts.source_urls(c("f_url"), c("official_site"), c("identity_site"), c("official_site")), " ").alias("urls"))


@registered(f"SELECT entity_id, count(*) FILTER (present AND category <> 'official site') AS breadth FROM ({SQL['source_coverage']}) GROUP BY 1")
def source_breadth(spark, sf):
    found = view(spark, sf, "findings")
    return coverage.source_breadth(coverage.source_coverage(found, coverage.signals_by_entity(found)))


# ---------------------------------------------------------------- proposals

def _builds(spark, sf):
    c = F.col
    fact = lambda v: F.when(c(v).isNotNull(), F.struct(c(v).alias("value"), c("f_confidence").alias("confidence"), c("f_url").alias("source_url")))
    named = {"lead_pastor": "f_pastor", "office_email": "f_email", "office_phone": "f_phone", "staff_count": "f_staff", "campus_count": "f_campus"}
    known = {"lead_pastor": "e_pastor", "office_email": "e_email", "denomination": "e_denomination"}
    maps = {
        "facts": F.create_map(*(x for k, v in named.items() for x in (F.lit(k), fact(v)))),
        "estimates": F.create_map(*(x for k, v in known.items() for x in (F.lit(k), c(v)))),
    }
    return view(spark, sf, "builds").withColumns(maps)


_ROWS = [
    ("website_verified", "CASE WHEN identity_verdict = 'true_match' AND coalesce(identity_site, '') <> '' THEN identity_site END", "identity_confidence", "false", "'Identity-verified official site (' || method || ')'", "identity_site", "NULL"),
    ("active_status", "CASE WHEN official_crawled THEN 'Verified Active' END", "research_confidence", "false", "'Official website is live and reachable'", "official_site", "NULL"),
    ("denomination", "denomination", f"coalesce(e_denomination, {_capped('65')})", "false", "'Denomination from dossier synthesis'", "official_site", "NULL"),
    ("lead_pastor", "coalesce(lead_pastor, f_pastor)", "e_pastor", "true", "'Lead pastor (contact)'", "CASE WHEN f_pastor IS NOT NULL THEN f_url END", "official_site"),
    ("email_verified", "f_email", "coalesce(e_email, f_confidence)", "true", "'Public office email'", "f_url", "NULL"),
    ("phone_verified", "f_phone", "f_confidence", "true", "'Public office phone'", "f_url", "NULL"),
    ("staff_count", "f_staff", "f_confidence", "false", "'Staff count'", "f_url", "NULL"),
    ("campus_count", "f_campus", "f_confidence", "false", "'Campus count'", "f_url", "NULL"),
]
PROPOSALS_SQL = ", made AS (" + " UNION ALL ".join(
    f"SELECT entity_id, {i} AS field_no, '{n}' AS field_name, {v} AS value, CAST({conf} AS DOUBLE) AS confidence, {contact} AS is_contact, {text} AS evidence_text, "
    f"concat_ws(' ', nullif({a}, ''), CASE WHEN {b} IS DISTINCT FROM {a} THEN nullif({b}, '') END) AS source_urls, access_level FROM builds"
    for i, (n, v, conf, contact, text, a, b) in enumerate(_ROWS)
) + "), proposed AS (SELECT * FROM made WHERE coalesce(value, '') <> '' AND confidence IS NOT NULL)"


@registered(PROPOSALS_SQL + "SELECT entity_id, CAST(field_no AS INT) AS field_no, field_name, value, confidence, is_contact, evidence_text, source_urls, access_level FROM proposed", "builds")
def dossier_proposals(spark, sf):
    out = apply.field_proposals(_builds(spark, sf))
    return out.withColumn("source_urls", F.array_join("source_urls", " "))


@registered(PROPOSALS_SQL + f"""
, capped AS (SELECT entity_id, field_no, field_name, value, is_contact, {_capped("confidence")} AS confidence FROM proposed),
j AS (SELECT c.*, p.prior, greatest(coalesce(p.prior, 0), c.confidence) AS existing, CASE c.field_name WHEN 'lead_pastor' THEN e.lead_name WHEN 'website_verified' THEN e.website WHEN 'email_verified' THEN e.email END AS current_value
      FROM capped c LEFT JOIN entities e ON e.id = c.entity_id LEFT JOIN (SELECT entity_id, CASE field_name WHEN '1-URGENT' THEN 'email_verified' WHEN '2-HIGH' THEN 'denomination' WHEN '3-MEDIUM' THEN 'lead_pastor' ELSE 'staff_count' END AS field_name, max(confidence) AS prior FROM evidence GROUP BY ALL) p ON p.entity_id = c.entity_id AND p.field_name = c.field_name),
g AS (SELECT *, coalesce(current_value, '') <> '' AS held, CASE WHEN is_contact AND confidence >= 85 AND confidence < 90 THEN 'review' ELSE {_gate("confidence")} END AS gate FROM j)
SELECT entity_id, CAST(field_no AS INT) AS field_no, field_name, value, confidence, CASE WHEN held AND existing > confidence THEN 'skipped' WHEN gate = 'update' AND held AND confidence < existing + 1 THEN 'review' ELSE gate END AS decision FROM g
""", "builds", "entities", "evidence")  # fmt: skip
def dossier_apply(spark, sf):
    """The proposals of a result, and what becomes of each beside what is held and on record."""
    e = view(spark, sf, "entities").select(F.col("id").alias("entity_id"), "lead_name", "website", "email")
    name = F.col("field_name")
    proposed = apply.field_proposals(_builds(spark, sf)).join(e, "entity_id", "left")
    held = F.when(name == "lead_pastor", F.col("lead_name")).when(name == "website_verified", F.col("website")).when(name == "email_verified", F.col("email"))
    named = F.when(name == "1-URGENT", "email_verified").when(name == "2-HIGH", "denomination").when(name == "3-MEDIUM", "lead_pastor").otherwise("staff_count")
    out = merge.merge_decisions(proposed.withColumn("current_value", held), view(spark, sf, "evidence").withColumn("field_name", named))
    return out.select("entity_id", "field_no", "field_name", "value", "confidence", "decision")


@registered(f"""
, c AS (SELECT entity_id, access_level, CAST(attendance AS STRING) AS a, CAST(attendance_min AS STRING) AS lo, CAST(attendance_max AS STRING) AS hi, {_capped("coalesce(attendance_confidence, 0)")} AS confidence FROM builds WHERE attendance IS NOT NULL AND attendance_min IS NOT NULL AND attendance_max IS NOT NULL),
t AS (SELECT *, CASE WHEN confidence >= 75 THEN 'High' WHEN confidence >= 55 THEN 'Medium' WHEN confidence >= 35 THEN 'Low' ELSE 'Very Low' END AS tier FROM c)
SELECT entity_id, 'attendance_estimate' AS field_name, a || ' [' || lo || '-' || hi || ']' AS value, confidence, tier, {_gate("confidence")} AS decision,
       'Attendance estimate ' || a || ' [' || lo || '–' || hi || '], tier ' || tier || ', confidence ' || CAST(CAST(confidence AS BIGINT) AS STRING) || ' (access ' || access_level || ').' AS evidence_text FROM t
""", "builds")  # fmt: skip
def dossier_attendance(spark, sf):
    return apply.attendance_proposals(view(spark, sf, "builds"))


@registered("SELECT e.id, e.name, b.access_level, CASE WHEN b.entity_id IS NULL THEN e.fit_score ELSE b.research_confidence END AS fit_score FROM (SELECT *, NULL AS access_level FROM entities) e LEFT JOIN (SELECT * FROM builds WHERE entity_id % 3 <> 0) b ON b.entity_id = e.id", "entities", "builds")
def research_metadata(spark, sf):
    results = view(spark, sf, "builds").where("entity_id % 3 <> 0").select(F.col("entity_id").alias("id"), "access_level", F.col("research_confidence").alias("fit_score"))
    e = view(spark, sf, "entities").select("id", "name", F.lit(None).cast("string").alias("access_level"), "fit_score")
    return apply.write_metadata(e, results, ["access_level", "fit_score"])


# ---------------------------------------------------------------- texts that are asked with

_BASE = "concat_ws(' ', nullif(name, ''), nullif(city, ''), nullif(state, ''))"
_PLACE = "SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE name END AS name, CASE WHEN id % 4 = 0 THEN NULL ELSE 'Lima' END AS city, state, CASE WHEN id % 3 = 0 THEN 'own.org' END AS official_host, website, email FROM entities"


def _places(spark, sf):
    c, e = F.col("id"), view(spark, sf, "entities")
    return e.select("id", F.when(c % 9 == 0, "").otherwise(F.col("name")).alias("name"), F.when(c % 4 != 0, "Lima").alias("city"), "state", F.when(c % 3 == 0, "own.org").alias("official_host"), "website", "email")


_TEMPLATES = [
    f"{_BASE} || ' church'", "CASE WHEN official_host IS NOT NULL THEN 'site:' || official_host ELSE name || ' ' || coalesce(city, '') || ' pastor' END", f"{_BASE} || ' pastor staff leadership team'",
    f"{_BASE} || ' attendance members weekly service times'", f"{_BASE} || ' facebook instagram'", f"{_BASE} || ' youtube sermons livestream watch online'", f"{_BASE} || ' church center subsplash planning center app giving'",
    f"{_BASE} || ' jobs hiring pastor position careers'", f"{_BASE} || ' network association denomination district'", "name || ' ' || coalesce(city, '') || ' news article announcement'",
]


@registered(f", p AS ({_PLACE}) SELECT id, CAST(i AS INT) AS query_no, q AS query FROM (" + " UNION ALL ".join(f"SELECT id, {i} AS i, {t} AS q FROM p" for i, t in enumerate(_TEMPLATES)) + ") WHERE length(trim(q)) > 3", "entities")
def snippet_queries(spark, sf):
    return texts.snippet_queries(_places(spark, sf))


@registered(f", p AS ({_PLACE}) SELECT id, concat_ws(' ', nullif(name, ''), nullif(city, ''), nullif(state, ''), 'church') AS query, 'CHURCH: ' || coalesce(name, '') || chr(10) || 'LOCATION: ' || concat_ws(', ', nullif(city, ''), nullif(state, '')) || chr(10) || 'ORIGINAL WEBSITE: ' || coalesce(website, 'none') || chr(10) || 'ORIGINAL PHONE: none' || chr(10) || 'ORIGINAL EMAIL: ' || coalesce(email, 'none') AS header FROM p", "entities")
def entity_headers(spark, sf):
    c, p = F.col, _places(spark, sf)
    return p.select("id", texts.discovery_query(c("name"), c("city"), c("state")).alias("query"), texts.entity_header(c("name"), c("city"), c("state"), c("website"), F.lit(None).cast("string"), c("email")).alias("header"))


@registered("SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(strip_accents(regexp_replace(lower(n), '([\u00c0-\u024f\u1e00-\u1eff])', '\\1 ', 'g')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ('de', 'la', 'el', 'iglesia')), ' ') AS tokens FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Iglesia Peña de la Paz' WHEN 1 THEN 'CAFÉ Zürich ' WHEN 2 THEN 'Łódź straße ' ELSE '' END || c_name AS n FROM customer)")
def accented_tokens(spark, sf):
    k = F.col("c_custkey") % 4
    name = F.concat(F.when(k == 0, "Iglesia Peña de la Paz").when(k == 1, "CAFÉ Zürich ").when(k == 2, "Łódź straße ").otherwise(""), F.col("c_name"))
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.array_join(I.tokens(name), " ").alias("tokens"))


@registered("""
, cut AS (SELECT row_idx, nullif(trim(sno), '') AS sno, nullif(trim(org_name), '') AS name FROM roster WHERE row_idx < 100)
SELECT row_idx, 'row-' || coalesce(sno, CAST(row_idx AS STRING)) AS original_row_id, name FROM cut
""", "roster")  # fmt: skip
def import_first_rows(spark, sf):
    """The first hundred rows of a roster, by their numbers."""
    return _records(spark, sf, keep_empty=True).where("row_idx < 100").select("row_idx", "original_row_id", "name")
