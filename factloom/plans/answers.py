"""Registered queries on model answers: schemas, verification, scores, pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import jsonfix, merge, runs, schemas
from factloom.plans.catalogue import QUERIES, SQL, registered
from factloom.sources.fixtures import view, with_views


def _answers(spark, sf):
    return jsonfix.parse_outputs(view(spark, sf, "answers")).drop("error")


# What each answer must have, written for the SQL by itself: schema, number, member, kind, may be null, range, options.
_PLAIN = """
('verification', 0, 'active_status', 'string', false, NULL, NULL, 'Verified Active|Likely Active|Uncertain|Closed|Merged'), ('verification', 1, 'website_verified', 'string', true, NULL, NULL, NULL),
('verification', 2, 'website_verified_confidence', 'number', false, 0, 100, NULL), ('verification', 3, 'active_status_confidence', 'number', false, 0, 100, NULL),
('verification', 4, 'closure_merger_signals', 'array', false, NULL, NULL, NULL), ('verification', 5, 'reasoning', 'string', false, NULL, NULL, NULL), ('verification', 6, 'evidence', 'array', false, NULL, NULL, NULL),
('contact', 0, 'email_verified', 'string', true, NULL, NULL, NULL), ('contact', 1, 'email_confidence', 'number', false, 0, 100, NULL), ('contact', 2, 'phone_verified', 'string', true, NULL, NULL, NULL),
('contact', 3, 'phone_confidence', 'number', false, 0, 100, NULL), ('contact', 4, 'lead_pastor', 'string', true, NULL, NULL, NULL), ('contact', 5, 'lead_pastor_confidence', 'number', false, 0, 100, NULL),
('contact', 6, 'evidence', 'array', false, NULL, NULL, NULL),
('denomination', 0, 'denomination', 'string', false, NULL, NULL, NULL), ('denomination', 1, 'denomination_confidence', 'number', false, 0, 100, NULL), ('denomination', 2, 'network_affiliation', 'string', false, NULL, NULL, NULL),
('denomination', 3, 'network_confidence', 'number', false, 0, 100, NULL), ('denomination', 4, 'evidence', 'array', false, NULL, NULL, NULL),
('size', 0, 'attendance_estimate', 'number', true, NULL, NULL, NULL), ('size', 1, 'attendance_min', 'number', true, NULL, NULL, NULL), ('size', 2, 'attendance_max', 'number', true, NULL, NULL, NULL),
('size', 3, 'attendance_confidence', 'number', false, 0, 100, NULL), ('size', 4, 'attendance_confidence_tier', 'string', false, NULL, NULL, 'High|Medium|Low|Very Low'), ('size', 5, 'staff_count', 'number', true, NULL, NULL, NULL),
('size', 6, 'campus_count', 'number', true, NULL, NULL, NULL), ('size', 7, 'weekend_services_count', 'number', true, NULL, NULL, NULL), ('size', 8, 'reasoning', 'string', false, NULL, NULL, NULL),
('size', 9, 'evidence', 'array', false, NULL, NULL, NULL),
('multiplication', 0, 'church_planting_activity', 'number', false, 0, 100, NULL), ('multiplication', 1, 'disciple_making', 'number', false, 0, 100, NULL), ('multiplication', 2, 'leadership_development', 'number', false, 0, 100, NULL),
('multiplication', 3, 'residency_internship', 'number', false, 0, 100, NULL), ('multiplication', 4, 'mission_sending', 'number', false, 0, 100, NULL), ('multiplication', 5, 'kingdom_collaboration', 'number', false, 0, 100, NULL),
('multiplication', 6, 'innovation', 'number', false, 0, 100, NULL), ('multiplication', 7, 'multiplication_orientation', 'number', false, 0, 100, NULL), ('multiplication', 8, 'digital_reach', 'number', false, 0, 100, NULL),
('multiplication', 9, 'explanation', 'string', false, NULL, NULL, NULL), ('multiplication', 10, 'evidence', 'array', false, NULL, NULL, NULL)
"""
_MEMBERS = "(0, 'field_name', 'string', false, NULL, NULL, NULL), (1, 'proposed_value', 'string', true, NULL, NULL, NULL), (2, 'evidence_text', 'string', false, NULL, NULL, NULL), (3, 'source_url', 'string', true, NULL, NULL, NULL), (4, 'confidence_score', 'number', false, 0, 100, NULL)"


def _kind(t: str) -> str:
    return f"CASE WHEN {t} IS NULL THEN 'undefined' WHEN {t} = 'NULL' THEN 'null' WHEN {t} = 'VARCHAR' THEN 'string' WHEN {t} = 'BOOLEAN' THEN 'boolean' WHEN {t} = 'OBJECT' THEN 'object' WHEN {t} = 'ARRAY' THEN 'array' ELSE 'number' END"


# The checked values have the columns answer_id, schema_name, o1, o2, o3 (order), path, kind, nullable, low, high, options, found (kind) and told (text).
VIOLATIONS_SQL = f"""
, rules AS (SELECT * FROM (VALUES {_PLAIN}) t(schema_name, no, name, kind, nullable, low, high, options)),
members AS (SELECT * FROM (VALUES {_MEMBERS}) t(no, name, kind, nullable, low, high, options)),
given AS (SELECT answer_id, schema_name, raw, CASE WHEN json_valid(raw) THEN json_type(raw) END AS root FROM answers),
tops AS (SELECT answer_id, schema_name, raw, no AS o1, -1 AS o2, -1 AS o3, name AS path, kind, nullable, low, high, options, {_kind("json_type(raw, '$.' || name)")} AS found, json_extract_string(raw, '$.' || name) AS told FROM given JOIN rules USING (schema_name) WHERE root = 'OBJECT'),
items AS (SELECT answer_id, schema_name, o1, i AS o2, path, json_extract(raw, '$.' || path || '[' || CAST(i AS VARCHAR) || ']') AS item
          FROM (SELECT *, unnest(range(0, CAST(json_array_length(json_extract(raw, '$.' || path)) AS BIGINT))) AS i FROM tops WHERE kind = 'array' AND found = 'array')),
inner_values AS (
    SELECT answer_id, schema_name, o1, o2, -1 AS o3, path || '[' || CAST(o2 AS VARCHAR) || ']' AS path, CASE path WHEN 'evidence' THEN 'object' ELSE 'string' END AS kind, false AS nullable, CAST(NULL AS INTEGER) AS low, CAST(NULL AS INTEGER) AS high, CAST(NULL AS VARCHAR) AS options, {_kind("json_type(item)")} AS found, json_extract_string(item, '$') AS told FROM items
    UNION ALL
    SELECT answer_id, schema_name, o1, o2, no, path || '[' || CAST(o2 AS VARCHAR) || '].' || name, kind, nullable, CAST(low AS INTEGER), CAST(high AS INTEGER), CAST(options AS VARCHAR), {_kind("json_type(item, '$.' || name)")}, json_extract_string(item, '$.' || name) FROM items, members WHERE path = 'evidence' AND json_type(item) = 'OBJECT'),
checked AS (
    SELECT answer_id, schema_name, o1, o2, o3, path, kind, nullable, low, high, options, found, told FROM tops UNION ALL SELECT * FROM inner_values
    UNION ALL SELECT answer_id, schema_name, -1, -1, -1, '', 'object', false, CAST(NULL AS INTEGER), CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR), coalesce(lower(root), 'no JSON'), NULL FROM given WHERE coalesce(root, '') <> 'OBJECT'),
judged AS (SELECT *, CASE WHEN found <> kind AND NOT (nullable AND found = 'null') THEN 'invalid_type' WHEN found = 'string' AND NOT list_contains(string_split(options, '|'), told) THEN 'invalid_enum_value'
    WHEN found = 'number' AND CAST(told AS DOUBLE) < low THEN 'too_small' WHEN found = 'number' AND CAST(told AS DOUBLE) > high THEN 'too_big' END AS problem FROM checked),
violations AS (SELECT answer_id, schema_name, CAST(row_number() OVER (PARTITION BY answer_id ORDER BY o1, o2, o3) - 1 AS INTEGER) AS violation_no, path, problem,
    CASE problem WHEN 'invalid_type' THEN kind WHEN 'invalid_enum_value' THEN options WHEN 'too_small' THEN 'at least 0' ELSE 'at most 100' END AS expected, CASE problem WHEN 'invalid_type' THEN found ELSE told END AS found FROM judged WHERE problem IS NOT NULL)
"""  # fmt: skip


def _of_schema(name: str):
    def run(spark, sf):
        answers = _answers(spark, sf).where(F.col("schema_name") == name)
        return schemas.violations(answers, ["answer_id", "schema_name"])

    return run


for _name in schemas.SCHEMAS:
    QUERIES[f"violations_{_name}"] = _of_schema(_name)
    SQL[f"violations_{_name}"] = with_views(VIOLATIONS_SQL + f"SELECT * FROM violations WHERE schema_name = '{_name}'", "answers")


# ---------------------------------------------------------------- verification and scores

_CLAMPED = "CAST(greatest(0, least(100, floor({} * 100 + 0.5) / 100)) AS DOUBLE)"
_ORIGIN = "lower(regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"
_HOST = "regexp_replace(lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '')"
VERIFIED_SQL = VIOLATIONS_SQL + f"""
, valid AS (SELECT entity_id, seq, a.raw, e.active_status AS held_active_status, e.website AS held_website_verified, e.website AS official_site FROM answers a JOIN entities e ON a.entity_id = e.id
            WHERE schema_name = 'verification' AND answer_id NOT IN (SELECT answer_id FROM violations)),
items_of AS (SELECT *, json_extract(raw, '$.evidence[' || CAST(item_no AS VARCHAR) || ']') AS e FROM (SELECT *, unnest(range(0, CAST(json_array_length(json_extract(raw, '$.evidence')) AS BIGINT))) AS item_no FROM valid)),
found_evidence AS (SELECT entity_id, seq, CAST(item_no AS INTEGER) AS item_no, json_extract_string(e, '$.field_name') AS field_name, json_extract_string(e, '$.proposed_value') AS value, json_extract_string(e, '$.evidence_text') AS evidence_text,
    json_extract_string(e, '$.source_url') AS source_url, official_site, CAST(json_extract_string(e, '$.confidence_score') AS DOUBLE) AS score FROM items_of),
evidence_rows AS (SELECT entity_id, seq, item_no, field_name, value, evidence_text, source_url,
    CASE WHEN coalesce(source_url, '') = '' THEN 'inference' WHEN {_HOST.format("source_url")} = '' THEN 'unknown' WHEN coalesce(official_site, '') <> '' AND starts_with(lower(source_url), {_ORIGIN.format("official_site")}) THEN 'official_site'
         WHEN contains({_HOST.format("source_url")}, 'facebook') THEN 'social' WHEN contains({_HOST.format("source_url")}, 'duckduckgo') THEN 'search' ELSE 'directory' END AS source_type, {_CLAMPED.format("score")} AS confidence FROM found_evidence),
url_lists AS (SELECT entity_id, seq, string_agg(source_url, ' ' ORDER BY item_no) AS source_urls FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, seq, source_url ORDER BY item_no) AS n FROM evidence_rows WHERE coalesce(source_url, '') <> '') WHERE n = 1 GROUP BY 1, 2),
signals AS (SELECT entity_id, seq, string_agg(s, '; ' ORDER BY i) AS signals FROM (SELECT entity_id, seq, i, json_extract_string(raw, '$.closure_merger_signals[' || CAST(i AS VARCHAR) || ']') AS s FROM (SELECT *, unnest(range(0, CAST(json_array_length(json_extract(raw, '$.closure_merger_signals')) AS BIGINT))) AS i FROM valid)) GROUP BY 1, 2),
told AS (
    SELECT entity_id, seq, 'active_status' AS field_name, json_extract_string(raw, '$.active_status') AS value, held_active_status AS current_value, CAST(json_extract_string(raw, '$.active_status_confidence') AS DOUBLE) AS sure,
           json_extract_string(raw, '$.reasoning') || coalesce(' | signals: ' || signals, '') AS evidence_summary FROM valid LEFT JOIN signals USING (entity_id, seq)
    UNION ALL
    SELECT entity_id, seq, 'website_verified', json_extract_string(raw, '$.website_verified'), held_website_verified, CAST(json_extract_string(raw, '$.website_verified_confidence') AS DOUBLE), 'Official website identified during verification' FROM valid),
gated AS (SELECT entity_id, seq, field_name, value, current_value, {_CLAMPED.format("sure")} AS confidence, CASE WHEN sure >= 85 THEN 'update' WHEN sure >= 60 THEN 'review' ELSE 'evidence_only' END AS decision, evidence_summary, coalesce(source_urls, '') AS source_urls
          FROM told LEFT JOIN url_lists USING (entity_id, seq) WHERE coalesce(value, '') <> ''),
scored AS (SELECT entity_id AS id, seq, least(100, CAST(json_extract_string(raw, '$.active_status_confidence') AS DOUBLE) * 0.6 + CAST(json_extract_string(raw, '$.website_verified_confidence') AS DOUBLE) * 0.4) AS s FROM valid QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1),
patched AS (SELECT e.id, coalesce(u.value, e.active_status) AS active_status, coalesce(w.value, e.website) AS website_verified, CASE WHEN s IS NOT NULL THEN {_CLAMPED.format("s")} END AS verification_score, coalesce(CAST(scored.seq AS BIGINT), e.last_checked_at) AS last_checked_at
    FROM entities e LEFT JOIN scored USING (id)
    LEFT JOIN (SELECT * FROM gated WHERE decision = 'update' AND field_name = 'active_status' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1) u ON u.entity_id = e.id
    LEFT JOIN (SELECT * FROM gated WHERE decision = 'update' AND field_name = 'website_verified' QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1) w ON w.entity_id = e.id)
"""  # fmt: skip


def _held(spark, sf):
    e = view(spark, sf, "entities")
    return e.select("id", F.col("website").alias("official_site"), "active_status", F.col("website").alias("website_verified"), F.lit(None).cast("double").alias("verification_score"), "last_checked_at")


def _verified(spark, sf):
    return runs.verification(_answers(spark, sf), _held(spark, sf))


def _patched(spark, sf):
    found = _verified(spark, sf)
    return merge.update_rows(_held(spark, sf).drop("official_site"), found.patches)


@registered(VERIFIED_SQL + "SELECT * FROM evidence_rows", "answers", "entities")
def verification_evidence(spark, sf):
    return _verified(spark, sf).evidence


@registered(VERIFIED_SQL + "SELECT * FROM patched", "answers", "entities")
def verification_updates(spark, sf):
    """All entities after the confident proposals and the score of their verification."""
    return _patched(spark, sf)


@registered(VERIFIED_SQL + "SELECT * FROM gated WHERE decision = 'review'", "answers", "entities")
def verification_reviews(spark, sf):
    return _verified(spark, sf).reviews.withColumn("source_urls", F.array_join("source_urls", " "))


@registered(VERIFIED_SQL + """
SELECT 'answers' AS output, count(*) AS n FROM valid UNION ALL SELECT 'evidence', count(*) FROM evidence_rows UNION ALL SELECT 'scores', count(*) FROM scored
UNION ALL SELECT field_name || ': ' || decision, count(*) FROM gated GROUP BY field_name, decision
""", "answers", "entities")  # fmt: skip
def verification_balance(spark, sf):
    """Rows of each output of the verification, with what became of the proposals."""
    found = _verified(spark, sf)
    counted = lambda rows, name: rows.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"))
    valid = schemas.typed(_answers(spark, sf), "verification", runs.KEYS).join(_held(spark, sf), F.col("entity_id") == F.col("id"))
    decided = found.proposals.groupBy(F.concat_ws(": ", "field_name", "decision").alias("output")).agg(F.count(F.lit(1)).alias("n"))
    return counted(valid, "answers").unionByName(counted(found.evidence, "evidence")).unionByName(counted(found.patches, "scores")).unionByName(decided)


_SUB = "greatest(0, least(100, {}))"
_A = "CAST(json_extract_string(raw, '$.{}') AS DOUBLE)"
_ROUND = "CAST(floor(({}) * 10 + 0.5) / 10 AS DOUBLE)"


@registered(VERIFIED_SQL + f"""
, last AS (SELECT entity_id AS id, raw FROM answers WHERE schema_name = 'multiplication' AND answer_id NOT IN (SELECT answer_id FROM violations) QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1),
read AS (SELECT id, {_A.format("multiplication_orientation")} AS o, {_A.format("church_planting_activity")} AS p, {_A.format("leadership_development")} AS l, {_A.format("kingdom_collaboration")} AS c, {_A.format("innovation")} AS i, {_A.format("digital_reach")} AS d FROM last),
fed AS (SELECT read.*, q.active_status, q.verification_score, CASE WHEN f.attendance > 0 THEN {_SUB.format("(log10(f.attendance) - 1) / 3 * 100")} ELSE 0 END AS att,
    {_SUB.format("(coalesce(f.campuses, 1) - 1) / 4 * 100")} AS cam, {_SUB.format("(coalesce(f.services, 1) - 1) / 4 * 100")} AS srv, {_SUB.format("coalesce(f.staff, 0) / 50 * 100")} AS stf, lower(coalesce(f.denomination, '') || ' ' || coalesce(f.network, '')) AS net
    FROM read JOIN patched q USING (id) JOIN profile f ON f.entity_id = id)
SELECT id, active_status, verification_score, {_ROUND.format("o * 0.35 + p * 0.35 + l * 0.2 + i * 0.1")} AS multiplication_score,
    {_ROUND.format("att * 0.3 + least(100, cam * 0.4 + srv * 0.25 + stf * 0.35) * 0.2 + d * 0.2 + (CASE WHEN trim(net) = '' OR contains(net, 'unknown') THEN 20 WHEN contains(net, 'southern baptist') OR contains(net, 'acts 29') THEN 75 WHEN contains(net, 'independent') THEN 45 ELSE 50 END) * 0.15 + l * 0.15")} AS influence_score,
    {_ROUND.format("o * 0.3 + p * 0.25 + l * 0.2 + c * 0.15 + i * 0.1")} AS fit_score, p AS planting_activity, l AS leadership_score, d AS digital_score FROM fed
""", "answers", "entities", "profile")  # fmt: skip
def multiplication_scores(spark, sf):
    """The scores of entities as their verification has left them."""
    profile = view(spark, sf, "profile").select(F.col("entity_id").alias("id"), "attendance", "campuses", "services", "staff", "denomination", "network")
    fresh = _patched(spark, sf).join(profile, "id")
    return fresh.select("id", "active_status", "verification_score").join(runs.multiplication(_answers(spark, sf), fresh), "id")


# ---------------------------------------------------------------- pipelines

@registered(VIOLATIONS_SQL + """
, requested AS (SELECT entity_id, run_type, schema_name FROM (SELECT DISTINCT entity_id FROM answers), (VALUES ('verify', 'verification'), ('score', 'multiplication')) r(run_type, schema_name)),
firsts AS (SELECT * FROM answers WHERE seq < 5),
wrongs AS (SELECT answer_id, problem || ' at ' || CASE path WHEN '' THEN 'the root' ELSE path END AS wrong FROM violations WHERE violation_no = 0),
runs AS (SELECT r.entity_id, r.run_type, b.entity_id IS NOT NULL AS known, coalesce(r.run_type <> 'verify' OR n_ok_pages > 0 OR n_results > 0, false) AS wanted, f.answer_id, w.wrong, length(f.raw) AS size
         FROM requested r LEFT JOIN bundles b USING (entity_id) LEFT JOIN firsts f ON f.entity_id = r.entity_id AND f.schema_name = r.schema_name LEFT JOIN wrongs w USING (answer_id))
SELECT entity_id, run_type, CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS status, error_message, called, CASE WHEN called THEN CAST(coalesce(ceil(size / 4), 0) AS BIGINT) ELSE 0 END AS tokens
FROM (SELECT *, known AND wanted AS called, CASE WHEN NOT known THEN 'entity ' || CAST(entity_id AS VARCHAR) || ' not found' WHEN wanted AND answer_id IS NULL THEN 'no answer' WHEN wanted THEN wrong END AS error_message FROM runs)
""", "answers", "bundles")  # fmt: skip
def pipeline_ledger(spark, sf):
    """Verification and scoring of every entity with answers: one that fails leaves the others be."""
    answers = _answers(spark, sf).where("seq < 5")
    first = schemas.violations(answers, ["answer_id"]).where("violation_no = 0").select("answer_id", "problem", "path")
    answers = answers.join(first, "answer_id", "left")
    kind = F.when(F.col("schema_name") == "verification", "verify").when(F.col("schema_name") == "multiplication", "score")
    mine = answers.select("entity_id", kind.alias("run_type"), "problem", "path", jsonfix.token_estimate(F.col("raw")).alias("tokens")).where("run_type is not null")
    requested = answers.select("entity_id").distinct().select("entity_id", F.explode(F.array(F.lit("verify"), F.lit("score"))).alias("run_type"))
    return runs.run_entities(requested, view(spark, sf, "bundles"), mine)


@registered("""
SELECT entity_id, 'research_status' AS field_name, 'needs manual research' AS proposed_value, CAST(0 AS DOUBLE) AS confidence,
    CASE WHEN coalesce(official_site, '') <> '' THEN trim('Found a candidate site (' || official_site || ') but could not read any pages [crawlMethod=' || coalesce(crawl_method, 'none') || ']. ' || coalesce(note, ''))
         ELSE 'No official website could be identified [crawlMethod=' || coalesce(crawl_method, 'none') || ']. ' || CASE n_results WHEN 0 THEN 'Web search returned no results (outbound search may be blocked).' ELSE 'Search returned only directory/social links.' END END AS evidence_summary,
    coalesce(official_site, '') AS source_urls, 'pending' AS review_status FROM bundles WHERE n_ok_pages = 0
""", "bundles")  # fmt: skip
def pipeline_queue(spark, sf):
    return runs.research_items(view(spark, sf, "bundles")).withColumn("source_urls", F.array_join("source_urls", " "))
