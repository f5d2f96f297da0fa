"""Registered queries: each a Spark plan over logical tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.config import ACCESS_LEVELS, DIRECTORY_HOSTS, MAJOR_NETWORKS, PAGE_CATEGORIES, STATES, STOP_WORDS
from factloom.functions import confidence as C
from factloom.functions import extract as X
from factloom.functions import html as H
from factloom.functions import identity as I
from factloom.functions import scoring as S
from factloom.functions import urls as U
from factloom.operators import calibrate, collect, coverage, discover, facts, ingest, jsonfix, merge, query, report, search, staff
from factloom.operators.ranking import first_per, top_per
from factloom.sources.fixtures import view, with_views
from factloom.sources.staging import staged
from factloom.streaming import evidence_log

QUERIES = {}
SQL = {}


def registered(sql: str | None = None, *views: str):
    """Register a query under its function's name, with its SQL over ``views``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


def _case(x: str, pairs: list[tuple[str, str]], other: str) -> str:
    return f"CASE {' '.join(f'WHEN {x} = {k!r} THEN {v}' for k, v in pairs)} ELSE {other} END"


CAP = _case("access_level", [(n, str(c)) for n, _, c in ACCESS_LEVELS], "NULL")
RANK = _case("access_level", [(n, str(i)) for i, (n, _, _) in enumerate(ACCESS_LEVELS)], "-1")


def _capped(raw: str, cap: str = CAP) -> str:
    return f"CAST(greatest(0, least({cap}, floor({raw} + 0.5))) AS DOUBLE)"


def _rounded(x: str, digits: int = 1) -> str:
    return f"CAST(floor(CAST({x} AS DOUBLE) * 1e{digits} + 0.5) / 1e{digits} AS DOUBLE)"


def _gate(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'update' WHEN {x} >= 60 THEN 'review' ELSE 'evidence_only' END"


# ---------------------------------------------------------------- facts

FACTS_SQL = """
SELECT entity_id, field_name, value, confidence, reliability * confidence AS score, {gate} AS decision
FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY reliability * confidence DESC, seq) AS pos FROM evidence) WHERE pos = 1
"""


@registered(FACTS_SQL.format(gate=_gate("reliability * confidence")), "evidence")
def fact_resolution(spark, sf):
    best = facts.best_facts(view(spark, sf, "evidence"))
    return best.select("entity_id", "field_name", "value", "confidence", "score", C.decide_update(F.col("score")).alias("decision"))


@registered("""
, led AS (SELECT *, first_value(value) OVER w AS top, row_number() OVER w AS pos FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS norm FROM fields) WINDOW w AS (PARTITION BY entity_id ORDER BY reliability DESC, seq)),
a AS (SELECT * FROM led WHERE pos = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY pos) AS r FROM led WHERE value <> top)
SELECT a.entity_id, a.key, a.value AS value_a, a.access_level AS level_a, b.value AS value_b, b.access_level AS level_b,
       CAST(least(CASE a.access_level WHEN 'live_official_site' THEN 95 WHEN 'staff_profile' THEN 75 ELSE 65 END, 60) AS DOUBLE) AS confidence
FROM a JOIN b USING (entity_id) WHERE b.r = 1
""", "fields")  # fmt: skip
def conflicts(spark, sf):
    rows = view(spark, sf, "fields")
    return facts.conflicts(rows.withColumn("norm", facts.norm_for_conflict(F.col("key"), F.col("value"))))


STATS = f"""
SELECT entity_id, max({RANK}) AS r, bool_or(access_level = 'live_official_site' AND fetched) AS official_crawled, count(DISTINCT source_type) AS source_types, count(*) AS source_count,
       count(*) FILTER (access_level IN ('live_official_site', 'staff_profile')) AS official_source_count, count(*) FILTER (access_level NOT IN ('live_official_site', 'staff_profile')) AS secondary_source_count
FROM findings GROUP BY entity_id"""
LEVEL_OF = f"coalesce({[n for n, _, _ in ACCESS_LEVELS]}[r + 1], 'search_snippets')"


@registered(f"""
SELECT * EXCLUDE (r), {_capped("least(source_types / 8.0, 1) * 55 + CASE WHEN official_crawled THEN 25 ELSE 0 END + CASE WHEN source_count >= 5 THEN 15 ELSE 5 END")} AS research_confidence
FROM (SELECT *, {LEVEL_OF} AS access_level FROM ({STATS}))
""", "findings")  # fmt: skip
def source_mix(spark, sf):
    stats = facts.source_statistics(view(spark, sf, "findings"))
    return stats.withColumn("research_confidence", facts.research_confidence(F.col("source_types"), F.col("official_crawled"), F.col("source_count"), F.lit(0), F.col("access_level")))


@registered("SELECT entity_id, field_name, max(confidence) AS existing_confidence FROM evidence GROUP BY ALL", "evidence")
def max_existing_confidence(spark, sf):
    return merge.best_evidence(view(spark, sf, "evidence"))


@registered(f"""
SELECT entity_id, field_name, value, {_capped("confidence")} AS confidence, access_level, origin FROM (
  SELECT entity_id, field_name, value, confidence, coalesce(nullif(access_level, 'search_snippets'), 'search_snippets') AS access_level, 0 AS origin FROM evidence
  UNION ALL SELECT entity_id, field_name, value, confidence, access_level, 1 FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, field_name ORDER BY reliability * confidence DESC, seq) AS pos FROM evidence) WHERE pos = 1)
""", "evidence")  # fmt: skip
def field_estimates_capped(spark, sf):
    rows = view(spark, sf, "evidence")
    told = rows.withColumns({"access_level": F.nullif("access_level", F.lit("search_snippets")), "dossier_level": F.lit("search_snippets")})
    return facts.estimates(told, facts.best_facts(rows))


# ---------------------------------------------------------------- query surface

@registered("SELECT * FROM entities WHERE active_status = 'Uncertain' AND last_checked_at IS NULL AND fit_score >= 10 AND contains(lower(name), 'customer') ORDER BY fit_score DESC NULLS LAST, id LIMIT 20 OFFSET 2", "entities")
def list_entities_page(spark, sf):
    f = query.EntityFilter(active_status="Uncertain", needs_verification=True, min_fit=10, search="Customer", limit=20, offset=2)
    return query.list_entities(view(spark, sf, "entities"), f)


@registered("SELECT * FROM entities WHERE coalesce(website, '') = '' AND coalesce(email, '') = '' AND coalesce(lead_name, '') = ''", "entities")
def filter_missing_fields(spark, sf):
    return query.filter_entities(view(spark, sf, "entities"), query.EntityFilter(missing_website=True, missing_email=True, missing_lead=True))


@registered("SELECT active_status, count(*) AS n FROM entities GROUP BY 1", "entities")
def count_by_status(spark, sf):
    return view(spark, sf, "entities").groupBy("active_status").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT count(*) AS n FROM entities WHERE state = 'CANADA'", "entities")
def count_filtered(spark, sf):
    return query.count_entities(view(spark, sf, "entities"), query.EntityFilter(state="CANADA"))


@registered("SELECT id, website, email, lead_name FROM entities WHERE website IS NULL OR email IS NULL OR lead_name IS NULL", "entities")
def missing_contact(spark, sf):
    return query.missing_contact(view(spark, sf, "entities")).select("id", "website", "email", "lead_name")


@registered("SELECT id, fit_score FROM entities WHERE fit_score IS NOT NULL ORDER BY fit_score DESC, id", "entities")
def high_fit(spark, sf):
    return query.high_fit(view(spark, sf, "entities")).select("id", "fit_score")


@registered("SELECT ref, id FROM (SELECT CASE WHEN id % 2 = 0 THEN original_row_id WHEN id % 5 = 0 THEN 'row-x' ELSE CAST(id AS STRING) END AS ref, CASE WHEN id % 2 <> 0 AND id % 5 = 0 THEN NULL ELSE id END AS id FROM entities)", "entities")
def resolve_ids(spark, sf):
    e = view(spark, sf, "entities")
    wanted = e.select(F.when(F.col("id") % 2 == 0, F.col("original_row_id")).when(F.col("id") % 5 == 0, F.lit("row-x")).otherwise(F.col("id").cast("string")).alias("ref"))
    return query.resolve_ids(e, wanted)


@registered("SELECT id, coalesce(n, 0) AS n_evidence, fields FROM entities LEFT JOIN (SELECT entity_id AS id, count(*) AS n, string_agg(field_name, ',' ORDER BY seq) AS fields FROM evidence GROUP BY 1) USING (id)", "entities", "evidence")
def entity_detail(spark, sf):
    out = query.entity_detail(view(spark, sf, "entities"), view(spark, sf, "evidence"))
    return out.select("id", F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("n_evidence"), F.array_join(F.transform("evidence", lambda e: e["field_name"]), ",").alias("fields"))


# ---------------------------------------------------------------- import

_ROSTER_HEADER = ["S.No", "Organization Name", "Street Address", "Address 2", "District", "Language"]


def _records(spark, sf, keep_empty=False):
    raw = view(spark, sf, "roster").select("row_idx", F.array(F.col("sno").cast("string"), "org_name", "street", "suite", "district", "lang").alias("cells"))
    return ingest.map_roster(raw, ingest.detect_columns(_ROSTER_HEADER), keep_empty)


RECORDS_SQL = """
, cut AS (SELECT row_idx, nullif(trim(sno), '') AS sno, nullif(trim(org_name), '') AS name, nullif(trim(street), '') AS a1, nullif(trim(suite), '') AS a2, district, lang FROM roster),
rec AS (SELECT row_idx, 'row-' || coalesce(sno, CAST(row_idx AS STRING)) AS original_row_id, name, nullif(concat_ws(', ', a1, a2), '') AS address,
               regexp_replace(lang, '^\\s*,?\\s*', '') AS language, district AS network_affiliation,
               name IS NULL OR regexp_matches(name, '^\\d{1,2}:\\d{2}(:\\d{2})?$') OR regexp_matches(name, '^\\d+(\\.\\d+)?$') AS suspect
        FROM cut WHERE coalesce(name, a1, a2) IS NOT NULL)
"""


@registered(RECORDS_SQL + """SELECT *, 'Seed parent org: ' || network_affiliation || CASE WHEN suspect THEN ' | Import warnings: suspect name value "' || coalesce(name, 'null') || '" — needs manual review' ELSE '' END AS notes FROM rec""", "roster")
def import_quality_flags(spark, sf):
    return _records(spark, sf).select("row_idx", "original_row_id", "name", "address", "language", "network_affiliation", "suspect", "notes")


@registered(RECORDS_SQL + "SELECT original_row_id, name, row_idx FROM rec WHERE original_row_id NOT IN (SELECT original_row_id FROM entities WHERE active_status = 'Closed') QUALIFY row_number() OVER (PARTITION BY original_row_id ORDER BY row_idx) = 1", "roster", "entities")
def import_first_wins(spark, sf):
    existing = view(spark, sf, "entities").where("active_status = 'Closed'")
    return merge.insert_absent(existing, _records(spark, sf), "original_row_id", [F.asc("row_idx")]).select("original_row_id", "name", "row_idx")


@registered(RECORDS_SQL + "SELECT n AS imported, (SELECT count(*) FROM rec) - n AS skipped, (SELECT count(*) FROM cut WHERE name IS NULL OR regexp_matches(name, '^[0-9]{1,2}:[0-9]{2}(:[0-9]{2})?$') OR regexp_matches(name, '^[0-9]+([.][0-9]+)?$')) AS warnings, (SELECT count(*) FROM roster) AS total FROM (SELECT count(DISTINCT original_row_id) AS n FROM rec WHERE original_row_id NOT IN (SELECT original_row_id FROM entities WHERE active_status = 'Closed'))", "roster", "entities")
def import_summary(spark, sf):
    return ingest.import_summary(_records(spark, sf, keep_empty=True), view(spark, sf, "entities").where("active_status = 'Closed'"))


@registered(RECORDS_SQL + "SELECT row_idx, coalesce(nullif(substr(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), ''), 'entity') AS slug FROM rec", "roster")
def slugs(spark, sf):
    return _records(spark, sf).select("row_idx", ingest.slug(F.col("name")).alias("slug"))


# ---------------------------------------------------------------- confidence and scores

@registered(f"""
SELECT entity_id, seq, {_capped("confidence * 1.3")} AS capped, {_gate("confidence")} AS gate,
       CASE WHEN confidence >= 90 THEN 'direct-official' WHEN confidence >= 75 THEN 'strong-multi-source' WHEN confidence >= 60 THEN 'plausible-incomplete' WHEN confidence >= 40 THEN 'weak-indirect' ELSE 'insufficient' END AS band,
       CASE WHEN confidence >= 75 THEN 'High' WHEN confidence >= 55 THEN 'Medium' WHEN confidence >= 35 THEN 'Low' ELSE 'Very Low' END AS tier,
       CAST(least(100, greatest(0, floor((confidence * 1.3 - 5) * 100 + 0.5) / 100)) AS DOUBLE) AS clamped
FROM evidence
""", "evidence")  # fmt: skip
def confidence_gate(spark, sf):
    e, c = view(spark, sf, "evidence"), F.col("confidence")
    return e.select(
        "entity_id", "seq", C.cap_confidence(c * 1.3, F.col("access_level")).alias("capped"), C.decide_update(c).alias("gate"), C.confidence_band(c).alias("band"),
        C.confidence_tier(c).alias("tier"), C.clamp_confidence(c * 1.3 - 5).alias("clamped"),
    )


@registered("SELECT CASE WHEN confidence >= 90 THEN 'direct-official' WHEN confidence >= 75 THEN 'strong-multi-source' WHEN confidence >= 60 THEN 'plausible-incomplete' WHEN confidence >= 40 THEN 'weak-indirect' ELSE 'insufficient' END AS band, count(*) AS n FROM evidence GROUP BY 1", "evidence")
def confidence_band_histogram(spark, sf):
    return view(spark, sf, "evidence").groupBy(C.confidence_band(F.col("confidence")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def _clamp(x: str) -> str:
    return f"greatest(0, least(100, {x}))"


_TEXT = "lower(coalesce(denomination, '') || ' ' || coalesce(network, ''))"
_ATT = f"CASE WHEN attendance > 0 THEN {_clamp('(log10(attendance) - 1) / 3 * 100')} ELSE 0 END"
_NET = f"CASE WHEN trim({_TEXT}) = '' OR contains({_TEXT}, 'unknown') THEN 20 WHEN {' OR '.join(f'contains({_TEXT}, {m!r})' for m in MAJOR_NETWORKS)} THEN 75 WHEN contains({_TEXT}, 'independent') OR contains({_TEXT}, 'non-denominational') THEN 45 ELSE 50 END"
_COMPLEX = _clamp(f"{_clamp('(coalesce(campuses, 1) - 1) / 4 * 100')} * 0.4 + {_clamp('(coalesce(services, 1) - 1) / 4 * 100')} * 0.25 + {_clamp('coalesce(staff, 0) / 50 * 100')} * 0.35")


@registered(f"SELECT entity_id, {_rounded(f'({_ATT}) * 0.3 + ({_COMPLEX}) * 0.2 + {_clamp("coalesce(digital, 0)")} * 0.2 + ({_NET}) * 0.15 + {_clamp("leadership")} * 0.15')} AS influence FROM profile", "profile")
def score_influence(spark, sf):
    p, c = view(spark, sf, "profile"), F.col
    return p.select("entity_id", S.influence_score(S.attendance_sub_score(c("attendance")), S.complexity_sub_score(c("campuses"), c("services"), c("staff")), F.coalesce(c("digital"), F.lit(0.0)), S.network_sub_score(c("denomination"), c("network")), c("leadership")).alias("influence"))


@registered(f"""SELECT entity_id, {_rounded(f'{_clamp("coalesce(growth, 0)")} * 0.3 + {_clamp("planting")} * 0.25 + {_clamp("leadership")} * 0.2 + {_clamp("coalesce(change, 0)")} * 0.15 + {_clamp("coalesce(digital, 0)")} * 0.1')} AS fit,
       {_rounded(f'{_clamp("coalesce(growth, 0)")} * 0.35 + {_clamp("planting")} * 0.35 + {_clamp("leadership")} * 0.2 + {_clamp("coalesce(digital, 0)")} * 0.1')} AS multiplication,
       CAST({_clamp("planting * 0.6 + leadership * 0.4")} AS DOUBLE) AS verification FROM profile""", "profile")
def score_fit(spark, sf):
    p, z = view(spark, sf, "profile"), lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return p.select(
        "entity_id", S.fit_score(z("growth"), F.col("planting"), F.col("leadership"), z("change"), z("digital")).alias("fit"),
        S.multiplication_score(z("growth"), F.col("planting"), F.col("leadership"), z("digital")).alias("multiplication"),
        S.verification_score(F.col("planting"), F.col("leadership")).alias("verification"),
    )


@registered(f"""
, j AS (SELECT *, {_capped("confidence")} AS c FROM proposals WHERE coalesce(value, '') <> '' AND confidence IS NOT NULL),
k AS (SELECT j.*, p.prior, greatest(coalesce(p.prior, 0), c) AS existing, coalesce(current_value, '') <> '' AS held FROM j LEFT JOIN (SELECT entity_id, field_name, max(confidence) AS prior FROM (SELECT entity_id, CASE field_name WHEN '1-URGENT' THEN 'email_verified' WHEN '2-HIGH' THEN 'denomination' ELSE 'staff_count' END AS field_name, confidence FROM evidence) GROUP BY ALL) p USING (entity_id, field_name)),
g AS (SELECT *, CASE WHEN is_contact AND c >= 85 AND c < 90 THEN 'review' ELSE {_gate("c")} END AS gate FROM k)
SELECT entity_id, field_name, seq, c AS confidence, prior AS prior_confidence, existing AS existing_confidence, CASE WHEN held AND existing > c THEN 'skipped' WHEN gate = 'update' AND held AND c < existing + 1 THEN 'review' ELSE gate END AS decision FROM g
""", "proposals", "evidence")  # fmt: skip
def merge_decisions(spark, sf):
    named = F.when(F.col("field_name") == "1-URGENT", "email_verified").when(F.col("field_name") == "2-HIGH", "denomination").otherwise("staff_count")
    out = merge.merge_decisions(view(spark, sf, "proposals"), view(spark, sf, "evidence").withColumn("field_name", named))
    return out.select("entity_id", "field_name", "seq", "confidence", "prior_confidence", "existing_confidence", "decision")


@registered(f"SELECT seq, CASE WHEN coalesce(value, '') = '' THEN 'evidence_only' ELSE {_gate('coalesce(confidence, 0)')} END AS decision FROM proposals", "proposals")
def apply_proposals(spark, sf):
    return view(spark, sf, "proposals").select("seq", merge.apply_proposal(F.col("value"), F.col("confidence")).alias("decision"))


@registered("SELECT e.id, coalesce(p.value, e.lead_name) AS lead_name, e.name FROM entities e LEFT JOIN (SELECT entity_id AS id, value FROM evidence QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1) p USING (id)", "entities", "evidence")
def update_entities(spark, sf):
    patch = merge.last_write(view(spark, sf, "evidence"), ["entity_id"], "seq").select(F.col("entity_id").alias("id"), F.col("value").alias("lead_name"))
    return merge.update_rows(view(spark, sf, "entities"), patch).select("id", "lead_name", "name")


# ---------------------------------------------------------------- review

@registered("""
, latest AS (SELECT id, entity_id, field_name, proposed_value, confidence, seq FROM queue WHERE review_status = 'approved' QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY seq DESC) = 1),
old AS (SELECT * FROM queue WHERE review_status = 'pending' QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY seq) = 1)
SELECT coalesce(o.id, n.id) AS id, entity_id, field_name, coalesce(n.proposed_value, o.proposed_value) AS proposed_value, coalesce(n.confidence, o.confidence) AS confidence, 'pending' AS review_status, coalesce(o.seq, n.seq) AS created_at
FROM old o FULL JOIN latest n USING (entity_id, field_name)
""", "queue")  # fmt: skip
def review_upsert(spark, sf):
    q = view(spark, sf, "queue").withColumn("created_at", F.col("seq"))
    pending = first_per(q.where("review_status = 'pending'"), ["entity_id", "field_name"], [F.asc("seq")])
    return merge.enqueue_reviews(pending, q.where("review_status = 'approved'"))


@registered("""
SELECT entity_id, field_name, proposed_value, CASE WHEN field_name IN ('staff_count', 'attendance_estimate') THEN CAST(TRY_CAST(proposed_value AS DOUBLE) AS STRING) ELSE proposed_value END AS applied_value
FROM queue WHERE review_status = 'approved' QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY confidence NULLS FIRST, seq DESC) = 1
""", "queue")  # fmt: skip
def review_apply(spark, sf):
    return merge.apply_reviews(view(spark, sf, "queue")).select("entity_id", "field_name", "proposed_value", "applied_value")


@registered("SELECT count(*) FILTER (review_status = 'pending') AS pending, count(*) FILTER (review_status = 'approved') AS approved_applied, count(*) FILTER (review_status = 'rejected') AS rejected, count(*) FILTER (review_status = 'needs_more_research') AS needs_more_research FROM queue", "queue")
def review_counts(spark, sf):
    return merge.review_counts(view(spark, sf, "queue"))


@registered(f"SELECT run_type, status, count(*) AS n_runs, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, {_rounded('sum(tokens_in / 1e6 * 3.0 + tokens_out / 1e6 * 15.0)', 4)} AS cost_estimate FROM runs GROUP BY 1, 2", "runs")
def run_ledger_totals(spark, sf):
    return report.run_totals(view(spark, sf, "runs"))


# ---------------------------------------------------------------- pages

_WS = r"'\s+', ' ', 'g'"


def _plain_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '&[#a-zA-Z0-9]+;', ' ', 'g')"


def _spaced_sql(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, chr(160), ' '), {_WS}))"


def _visible_sql(x: str = "html") -> str:
    for tag in H.HIDDEN:
        x = f"regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    return _spaced_sql(_plain_sql(f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"))


@registered(f"SELECT page_id, {_visible_sql()} AS visible FROM site_pages", "site_pages")
def html_visible_text(spark, sf):
    return view(spark, sf, "site_pages").select("page_id", H.visible_text(F.col("html")).alias("visible"))


@registered(f"""SELECT page_id, t AS title, {_spaced_sql("t || ' | ' || '' || ' | ' || '' || ' | ' || h1 || ' | ' || d")} AS identity FROM (SELECT page_id,
  {_spaced_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS t, regexp_replace({_spaced_sql("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, '<[^>]+>', ' ', 'g') AS h1,
  {_spaced_sql("regexp_extract(html, '(?i)<meta[^>]+name=[\"'']description[\"''][^>]+content=[\"'']([^\"'']+)[\"'']', 1)")} AS d FROM site_pages)""", "site_pages")
def html_title_identity(spark, sf):
    return view(spark, sf, "site_pages").select("page_id", H.title(F.col("html")).alias("title"), H.identity_text(F.col("html")).alias("identity"))


_LINK_SQL = "'(?is)<a\\b[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>'"
LINKS_SQL = f"""
, pairs AS (SELECT page_id, url, unnest(regexp_extract_all(html, {_LINK_SQL}, 1)) AS href, unnest(regexp_extract_all(html, {_LINK_SQL}, 2)) AS inner_html, generate_subscripts(regexp_extract_all(html, {_LINK_SQL}, 1), 1) AS p FROM site_pages),
kept AS (SELECT page_id, url, CAST(row_number() OVER (PARTITION BY page_id ORDER BY p) - 1 AS INT) AS link_seq, href, {_spaced_sql(_plain_sql("inner_html"))} AS text FROM pairs WHERE NOT regexp_matches(href, '(?i)^(javascript:|data:)'))
"""


def _links(spark, sf):
    return view(spark, sf, "site_pages").select("page_id", "url", F.posexplode(H.links(F.col("html"))).alias("link_seq", "l")).select("page_id", "url", "link_seq", "l.href", "l.text")


@registered(LINKS_SQL + "SELECT page_id, link_seq, href, text FROM kept", "site_pages")
def html_links(spark, sf):
    return _links(spark, sf).select("page_id", "link_seq", "href", "text")


_CATEGORY = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(hay, {w!r})' for w in ws)} THEN '{n}'" for n, ws in PAGE_CATEGORIES) + " END"


@registered(LINKS_SQL + f"SELECT page_id, category, href, link_seq FROM (SELECT *, {_CATEGORY} AS category FROM (SELECT *, lower(href || ' ' || text) AS hay FROM kept)) WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, category ORDER BY link_seq) = 1", "site_pages")
def link_categories_first(spark, sf):
    named = _links(spark, sf).withColumn("category", H.categorize(F.col("href"), F.col("text"))).where("category is not null")
    return first_per(named, ["page_id", "category"], [F.asc("link_seq")]).select("page_id", "category", "href", "link_seq")


@registered(LINKS_SQL + """SELECT page_id, string_agg(CASE WHEN starts_with(lower(href), 'mailto:') THEN trim(regexp_replace(substr(href, 8), '\\?.*$', '')) END, ',' ORDER BY link_seq) AS mails,
       string_agg(CASE WHEN starts_with(lower(href), 'tel:') THEN trim(regexp_replace(substr(href, 5), '\\?.*$', '')) END, ',' ORDER BY link_seq) AS phones FROM kept GROUP BY page_id""", "site_pages")
def mailto_tel(spark, sf):
    found = view(spark, sf, "site_pages").withColumn("l", H.links(F.col("html"))).where(F.size("l") > 0)
    one = lambda scheme: F.nullif(F.array_join(H.addresses(F.col("l"), scheme), ","), F.lit(""))
    return found.select("page_id", one("mailto").alias("mails"), one("tel").alias("phones"))


_SIGNAL_WORDS = "(^|[^a-z0-9_])(staff|team|leadership|elders?|pastors?|contact|connect|about|visit|ministr|campus|locations?|sermons?)([^a-z0-9_]|$)"


@registered(f"""
, seen AS (SELECT page_id, html, {_visible_sql()} AS t FROM site_pages),
s AS (SELECT page_id, html, t, contains(lower(html), 'mailto:') OR contains(lower(html), 'tel:') OR regexp_matches(lower(html), '{_SIGNAL_WORDS}') AS nav FROM seen)
SELECT page_id, nav AS nav_signals, length(t) < 600 OR (regexp_matches(html, '(?i)<div[^>]+id=["''](root|app|__next|__nuxt)["'']') AND length(t) < 1500)
  OR (len(regexp_extract_all(html, '(?i)<script\\b')) >= 8 AND len(regexp_extract_all(html, '(?i)<a\\b')) < 5) OR regexp_matches(html, '(?i)please enable javascript|you need to enable javascript|enable js to') OR (length(t) < 1500 AND NOT nav) AS thin FROM s
""", "site_pages")  # fmt: skip
def thin_pages(spark, sf):
    p = view(spark, sf, "site_pages")
    return p.select("page_id", H.has_nav_signals(F.col("html")).alias("nav_signals"), H.is_thin(F.col("html"), H.visible_text(F.col("html"))).alias("thin"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '')"
_DIR = " OR ".join(f"contains(host, {h!r})" for h in DIRECTORY_HOSTS)


@registered(f"SELECT page_id, host, CASE WHEN host = '' THEN '' WHEN path = '' THEN '/' ELSE path END AS path, host = '' OR {_DIR} OR regexp_matches(host, '[a-z]churches\\.(com|org|net)$') AS directory FROM (SELECT page_id, {_HOST} AS host, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)) AS path FROM site_pages)", "site_pages")
def url_hosts(spark, sf):
    return view(spark, sf, "site_pages").select("page_id", U.host_of(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"), U.is_directory(F.col("url")).alias("directory"))


@registered("""
, web AS (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM results WHERE starts_with(url, 'http')),
once AS (SELECT * FROM web QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY provider_rank, pos) = 1),
asked AS (SELECT query_id, provider_rank FROM (SELECT DISTINCT query_id, provider_rank FROM results) r
          WHERE (SELECT count(DISTINCT host) FROM once o WHERE o.query_id = r.query_id AND o.provider_rank < r.provider_rank) < 5)
SELECT query_id, url, provider_rank, CAST(rank AS INT) AS rank FROM (SELECT once.*, row_number() OVER (PARTITION BY query_id ORDER BY provider_rank, pos) AS rank FROM once JOIN asked USING (query_id, provider_rank)) WHERE rank <= 12
""", "results")  # fmt: skip
def meta_search_cut(spark, sf):
    wide = view(spark, sf, "results")
    return search.meta_search(wide).select("query_id", "url", "provider_rank", "rank")


@registered("""
, parsed AS (SELECT origin, line_no, lower(trim(split_part(l, ':', 1))) AS kind, trim(substr(l, position(':' IN l) + 1)) AS value FROM (SELECT *, trim(regexp_replace(line, '#.*$', '')) AS l FROM robots)),
active AS (SELECT *, last_value(CASE WHEN kind = 'user-agent' THEN value = '*' OR contains('factloom', lower(value)) END IGNORE NULLS) OVER (PARTITION BY origin ORDER BY line_no) AS on_ FROM parsed),
rules AS (SELECT origin, kind, value FROM active WHERE on_ AND kind IN ('allow', 'disallow') AND value <> ''),
places AS (SELECT *, coalesce(nullif(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path FROM robot_urls),
hit AS (SELECT places.origin, url, kind, CASE WHEN regexp_matches(path, '^' || replace(regexp_replace(CASE WHEN value LIKE '%$' THEN substr(value, 1, length(value) - 1) ELSE value END, '([.+?^${}()|\\[\\]\\\\])', '\\\\\\1', 'g'), '*', '.*') || CASE WHEN value LIKE '%$' THEN '$' ELSE '' END) THEN length(value) END AS n FROM places LEFT JOIN rules USING (origin))
SELECT origin, url, coalesce(max(n) FILTER (kind = 'disallow'), -1) = -1 OR coalesce(max(n) FILTER (kind = 'allow'), -1) >= coalesce(max(n) FILTER (kind = 'disallow'), -1) AS allowed FROM hit GROUP BY ALL
""", "robots", "robot_urls")  # fmt: skip
def robots_allow(spark, sf):
    rules = search.robots_rules(view(spark, sf, "robots"), "factloom")
    return search.robots_allowed(view(spark, sf, "robot_urls"), rules).select("origin", "url", "allowed")


# ---------------------------------------------------------------- identity

_KIND_WEIGHT = _case("kind", [(k, str(v)) for k, v in I.KIND_WEIGHT.items()], "-5")
IDENTITY_SQL = f"""
, base AS (SELECT *, (CASE WHEN source = 'original' THEN 40 ELSE 0 END) + (CASE WHEN name_strong THEN 45 WHEN name_ratio >= 0.5 THEN 22 ELSE -40 END) + (CASE place WHEN 'match' THEN 25 WHEN 'conflict' THEN -30 ELSE 0 END)
  + {_KIND_WEIGHT} + (CASE WHEN reachable THEN 5 ELSE 0 END) + (CASE WHEN content THEN 5 ELSE 0 END) AS raw FROM candidates),
scored AS (SELECT *, CASE WHEN NOT reachable OR parked OR NOT usable_name THEN 0 WHEN kind = 'vendor_reference' THEN 15 ELSE greatest(0, least(100, CASE WHEN kind <> 'official' OR NOT (source = 'original' OR name_strong OR place = 'match' OR ownership >= 2) THEN least(raw, 44) ELSE raw END)) END AS identity FROM base)
"""


def _scored(spark, sf):
    c = F.col
    score = I.identity_score(c("reachable"), c("parked"), c("usable_name"), c("kind"), c("source") == "original", c("name_strong"), c("name_ratio"), c("place"), c("content"), c("ownership"))
    return view(spark, sf, "candidates").withColumn("identity", score)


@registered(IDENTITY_SQL + "SELECT seq, CAST(identity AS INT) AS identity, CASE WHEN identity >= 65 THEN 'true_match' WHEN identity >= 45 THEN 'uncertain' ELSE 'no_match' END AS verdict FROM scored", "candidates")
def identity_score(spark, sf):
    return _scored(spark, sf).select("seq", "identity", I.verdict(F.col("identity")).alias("verdict"))


@registered(IDENTITY_SQL + "SELECT entity_id, seq, url, CAST(identity AS INT) AS identity FROM scored WHERE kind = 'official' AND identity >= 65 QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY identity DESC, seq) = 1", "candidates")
def identity_winner(spark, sf):
    return search.choose_site(_scored(spark, sf)).select("entity_id", "seq", "url", "identity")


@registered(IDENTITY_SQL + "SELECT entity_id, seq, CAST(rank AS INT) AS rank, CAST(identity AS INT) AS identity FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY identity DESC, seq) AS rank FROM scored) WHERE rank <= 8", "candidates")
def discovery_report(spark, sf):
    return top_per(_scored(spark, sf), ["entity_id"], [F.desc("identity"), F.asc("seq")], 8).select("entity_id", "seq", "rank", "identity")


@registered("SELECT entity_id, url, seq FROM candidates WHERE name_full AND place = 'conflict' AND (kind = 'official' OR source = 'search') QUALIFY row_number() OVER (PARTITION BY entity_id, url ORDER BY seq) = 1", "candidates")
def contamination(spark, sf):
    return search.contamination(view(spark, sf, "candidates")).select("entity_id", "url", "seq")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NAME_SQL = "'First ' || p_name || ' Church of ' || p_type"


def _tok(x: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"


@registered(f"SELECT p_partkey, array_to_string({_tok(_NAME_SQL)}, ' ') AS tokens, CAST(len(list_filter({_tok(_NAME_SQL)}, lambda w: length(w) >= 3 AND regexp_matches(w, '[a-z]'))) AS INT) AS n_distinctive FROM part")
def name_tokens(spark, sf):
    name = F.concat(F.lit("First "), "p_name", F.lit(" Church of "), "p_type")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.array_join(I.tokens(name), " ").alias("tokens"), F.size(I.distinctive(name)).alias("n_distinctive"))


_SLUG = f"array_to_string({_tok('c_name')}, '')"
_CITY = f"array_to_string({_tok('n_name')}, '')"


@registered(f"""
WITH s AS (SELECT c_custkey, {_SLUG} AS n, {_CITY} AS c FROM customer JOIN nation ON c_nationkey = n_nationkey),
l AS (SELECT c_custkey, list_filter([n, n || 'church', n || 'naz', n || 'nazarene', CASE WHEN c <> n THEN n || c END, c || 'naz', c || 'nazarene'], lambda x: x IS NOT NULL AND length(x) >= 4) AS slugs FROM s)
SELECT c_custkey, array_to_string(list_slice(flatten(list_transform(slugs, lambda x: ['https://www.' || x || '.org', 'https://www.' || x || '.church', 'https://www.' || x || '.com', 'https://www.' || x || '.net'])), 1, 20), ' ') AS guesses FROM l
""")  # fmt: skip
def domain_guesses(spark, sf):
    people = spark.read.parquet(f"{sf}/customer.parquet").join(F.broadcast(spark.read.parquet(f"{sf}/nation.parquet")), F.col("c_nationkey") == F.col("n_nationkey"))
    return people.select("c_custkey", F.array_join(I.domain_guesses(F.col("c_name"), F.col("n_name"), F.lit(None).cast("string")), " ").alias("guesses"))


_STATES = ", ".join(f"'{s}'" for s in STATES)


@registered(f"""SELECT s_suppkey, CASE WHEN contains(lower(t), 'peru') THEN 'match' WHEN len(list_filter(regexp_extract_all(t, ',\\s*([A-Z]{{2}})\\b', 1), lambda x: x IN ({_STATES}))) > 0 AND NOT list_contains(regexp_extract_all(t, ',\\s*([A-Z]{{2}})\\b', 1), 'OH') THEN 'conflict' ELSE 'unknown' END AS place
FROM (SELECT s_suppkey, s_name || ' of ' || CASE s_suppkey % 4 WHEN 0 THEN 'Peru, OH' WHEN 1 THEN 'Lima, TX' WHEN 2 THEN 'Lima, OH and Waco, TX' ELSE 'Lima, ZZ' END AS t FROM supplier)""")
def location_status(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    k = F.col("s_suppkey") % 4
    t = F.concat("s_name", F.lit(" of "), F.when(k == 0, "Peru, OH").when(k == 1, "Lima, TX").when(k == 2, "Lima, OH and Waco, TX").otherwise("Lima, ZZ"))
    return s.select("s_suppkey", I.location_status(t, F.lit(""), F.lit("Peru"), F.lit("oh")).alias("place"))


# ---------------------------------------------------------------- text

def _texts(spark, sf):
    return view(spark, sf, "texts")


# letters and digits that a word may not touch, as DuckDB's expressions have no look-around
_YEAR = "'(?i)\\b(?:began|founded|established|planted|started|est\\.?|since)\\s+(?:in\\s+)?((?:18|19|20)\\d{2})\\b'"


@registered(f"""
, m AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, {_YEAR}, 1), '') AS INT) AS told,
  TRY_CAST(coalesce(nullif(regexp_extract(text, '(?i)celebrat\\w*\\s+(\\d{{1,3}})\\s+years', 1), ''), nullif(regexp_extract(text, '(?i)(\\d{{1,3}})(?:th|st|nd|rd)?\\s+anniversary', 1), '')) AS INT) AS age,
  TRY_CAST(coalesce(nullif(regexp_extract(text, '(?i)\\bin\\s+((?:19|20)\\d{{2}})\\b', 1), ''), nullif(regexp_extract(text, '\\b((?:19|20)\\d{{2}})\\b', 1), '')) AS INT) AS pos FROM texts),
y AS (SELECT doc_id, CASE WHEN told > 1800 AND told <= 2024 THEN told END AS told, CASE WHEN age > 1 AND age < 200 AND pos - age > 1800 AND pos - age <= 2024 THEN pos - age END AS counted FROM m)
SELECT doc_id, coalesce(told, counted) AS founded_year, CAST(CASE WHEN told IS NOT NULL THEN 70 WHEN counted IS NOT NULL THEN 64 END AS DOUBLE) AS confidence FROM y
""", "texts")  # fmt: skip
def founded_year(spark, sf):
    year, conf = X.founded_year(F.col("text"))
    return _texts(spark, sf).select("doc_id", year.alias("founded_year"), conf.alias("confidence"))


@registered("""
, m AS (SELECT doc_id, text, lower(regexp_extract(text, '(?i)\\b(\\d+|one|two|three|four|five|six|seven|eight|nine|ten)\\s+(?:campuses|locations|sites)\\b', 1)) AS w,
  coalesce(nullif(regexp_extract(text, '(?i)\\bteam of\\s+(\\d+)\\b', 1), ''), nullif(regexp_extract(text, '(?i)\\b(\\d+)\\s+(?:full-?time\\s+)?(?:staff|team members|employees)\\b', 1), '')) AS n FROM texts),
k AS (SELECT *, coalesce(TRY_CAST(w AS INT), CAST(nullif(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], w), 0) AS INT)) AS told, regexp_matches(text, '(?i)\\b(?:one|single)\\s+(?:location|campus|site)\\b') AS single,
  regexp_matches(text, '(?i)\\bmulti-?site\\b|\\ball (?:our )?(?:campuses|locations)\\b|\\bother locations\\b|\\bcampus pastor\\b') AS several FROM m)
SELECT doc_id, coalesce(told, CASE WHEN single THEN 1 END) AS campus_count, CASE WHEN told IS NOT NULL THEN told > 1 WHEN single THEN false WHEN several THEN true END AS multi_site,
       CASE WHEN TRY_CAST(n AS INT) BETWEEN 1 AND 1999 THEN CAST(n AS INT) END AS staff_count FROM k
""", "texts")  # fmt: skip
def campus_staff(spark, sf):
    count, multi, _ = X.campuses(F.col("text"))
    return _texts(spark, sf).select("doc_id", count.alias("campus_count"), multi.alias("multi_site"), X.staff_count(F.col("text")).alias("staff_count"))


_HAY = "lower(text || ' ' || url)"
_FIRST = lambda pairs: "CASE " + " ".join(f"WHEN regexp_matches({_HAY}, '{p}') THEN '{n}'" for p, n in pairs) + " END"


@registered(f"""
, m AS (SELECT *, regexp_matches({_HAY}, '\\b(give online|online giving|give now|donate|giving|ways to give)\\b') OR regexp_matches(url, '/give|/giving|/donate') AS gives, regexp_matches({_HAY}, 'apps\\.apple\\.com|play\\.google\\.com/store/apps') AS store,
  regexp_matches({_HAY}, '\\b(our|the)\\s+(mobile\\s+)?app\\b|download our app') AS named, regexp_matches({_HAY}, '\\bno (?:mobile )?app\\b') AS denied FROM texts)
SELECT doc_id, gives AS giving, CASE WHEN gives THEN {_FIRST(X.GIVING_PROVIDERS)} END AS giving_provider, CASE WHEN store OR named THEN 'active' WHEN denied THEN 'none_found' END AS app_status, CASE WHEN store OR named THEN {_FIRST(X.APP_PROVIDERS)} END AS app_provider FROM m
""", "texts")  # fmt: skip
def giving_app(spark, sf):
    gives, provider = X.giving(F.col("text"), F.col("url"))
    status, app_provider, _ = X.app(F.col("text"), F.col("url"))
    return _texts(spark, sf).select("doc_id", gives.alias("giving"), provider.alias("giving_provider"), status.alias("app_status"), app_provider.alias("app_provider"))


def _role_sql(title: str) -> str:
    shapes = [f"(?i){X.NAME}\\s+(?:is\\s+(?:the|our)\\s+|serves as\\s+(?:the|our)\\s+)?{title}", f"(?i){title}[\\s:,\\-–|]+{X.NAME}", f"(?i){X.NAME}[\\s,\\-–|]+(?:{title})"]
    return "trim(coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{x}', 1), '')" for x in shapes) + "))"


@registered("SELECT doc_id, " + ", ".join(f"{_role_sql(t)} AS {n}" for n, t in X.ROLES) + " FROM texts", "texts")
def roles(spark, sf):
    return _texts(spark, sf).select("doc_id", *(X.role_name(F.col("text"), t).alias(n) for n, t in X.ROLES))


@registered(f"""
, m AS (SELECT doc_id, regexp_extract_all(text, '{X.EMAIL}') AS mails, nullif(regexp_extract(text, '{X.PHONE}'), '') AS phone FROM texts),
k AS (SELECT *, list_filter(mails, lambda e: regexp_matches(e, '(?i)^(info|connect|hello|office|contact|admin|church|welcome)@'))[1] AS office FROM m)
SELECT doc_id, coalesce(office, mails[1]) AS email, CAST(CASE WHEN office IS NOT NULL THEN 60 WHEN mails[1] IS NOT NULL THEN 45 END AS DOUBLE) AS email_confidence, phone FROM k
""", "texts")  # fmt: skip
def contact_email_phone(spark, sf):
    email, conf = X.office_email(F.col("text"))
    return _texts(spark, sf).select("doc_id", email.alias("email"), conf.alias("email_confidence"), X.phone(F.col("text")).alias("phone"))


_FOLLOW = "trim(regexp_extract(text, '(?i)([\\d][\\d,.]*\\s*[KkMm]?)\\s+(followers|subscribers|likes)', 1))"
_ADDRESS = "regexp_extract(text, '\\b\\d{2,6}\\s+[A-Z][A-Za-z0-9 .]+\\b(?:Rd|Road|St|Street|Ave|Avenue|Blvd|Dr|Drive|Lane|Ln|Way|Hwy|Pkwy)\\b')"


@registered(f"""
SELECT doc_id, field_name, value, confidence FROM (
  SELECT doc_id, CASE WHEN kind IN ('instagram', 'facebook') THEN kind || '_followers' WHEN kind = 'youtube' THEN 'youtube_subscribers' ELSE 'social_followers' END AS field_name, nullif({_FOLLOW}, '') AS value, CAST(55 AS DOUBLE) AS confidence FROM texts
  UNION ALL SELECT doc_id, 'lead_pastor_title_mention', nullif(regexp_extract(text, '(?i)\\b(?:lead|senior|associate|executive|founding)\\s+pastor\\b'), ''), 45 FROM texts
  UNION ALL SELECT doc_id, 'phone', nullif(regexp_extract(text, '{X.PHONE}'), ''), 50 FROM texts
  UNION ALL SELECT doc_id, 'address', nullif({_ADDRESS}, ''), 45 FROM texts) WHERE value IS NOT NULL
""", "texts")  # fmt: skip
def snippet_fields(spark, sf):
    rows = _texts(spark, sf).select("doc_id", F.inline(X.snippet_facts(F.col("kind"), F.col("text"))))
    return rows


@registered()
def text_facts(spark, sf):
    """All candidates of each text in one projection, and the best per field."""
    rows = X.text_facts(_texts(spark, sf).withColumnRenamed("doc_id", "entity_id"), ["entity_id"], F.col("text"), F.col("url"))
    return facts.best_facts(rows.withColumns({"reliability": F.lit(0.5), "seq": F.lit(0)})).select("entity_id", "field_name", "value", "confidence")


_SIGNAL = ", ".join(f"regexp_matches(hay, '(?i){p}') AS s{i}" for i, (_, p) in enumerate(X.SIGNALS))
_PLATFORM = ", ".join(f"CASE WHEN regexp_matches(hay, '(?i){p}') THEN '{n}' END" for n, p in X.PLATFORMS)
SIGNALS_SQL = f"""
, hays AS (SELECT entity_id, string_agg(title || ' ' || body || ' ' || url, ' \n ' ORDER BY seq) AS hay FROM findings GROUP BY 1),
raw_signals AS (SELECT entity_id, list_filter([{_PLATFORM}], lambda x: x IS NOT NULL) AS platforms, {_SIGNAL} FROM hays),
signals AS (SELECT entity_id, platforms, {", ".join(f"s{i} AS {n}" for i, (n, _) in enumerate(X.SIGNALS) if n != "church_app")}, s{len(X.SIGNALS) - 1} OR list_has_any(platforms, ['Subsplash', 'Church Center']) AS church_app FROM raw_signals),
counted AS (SELECT *, CAST({" + ".join(f"CAST({n} AS INT)" for n, _ in X.SIGNALS)} + CASE WHEN len(platforms) > 0 THEN 1 ELSE 0 END AS INT) AS signals_detected FROM signals)
"""


@registered(SIGNALS_SQL + "SELECT entity_id, array_to_string(platforms, ', ') AS platforms, " + ", ".join(n for n, _ in X.SIGNALS) + ", signals_detected FROM counted", "findings")
def digital_signals(spark, sf):
    out = coverage.signals_by_entity(view(spark, sf, "findings"))
    return out.select("entity_id", F.array_join("platforms", ", ").alias("platforms"), *(n for n, _ in X.SIGNALS), "signals_detected")


def _coverage(spark, sf):
    found = view(spark, sf, "findings")
    signals = coverage.signals_by_entity(found)
    links = found.select("entity_id", "category").where(~F.col("fetched"))
    known = view(spark, sf, "evidence").select("entity_id", F.when(F.col("field_name") == "1-URGENT", "lead_pastor").when(F.col("field_name") == "2-HIGH", "office_email").when(F.col("field_name") == "5-LOW", "founded_year").otherwise("other").alias("field_name"), "value")
    return coverage.coverage_rows(found, links, known, signals), signals


COVERAGE_SQL = SIGNALS_SQL + """
, first_page AS (SELECT entity_id, k AS category, min_by(rendered, seq) AS rendered, min_by(text_length, seq) AS text_length FROM (
    SELECT *, CASE WHEN category = 'home' THEN 'homepage' WHEN NOT fetched THEN NULL WHEN category = 'leadership' THEN 'staff' ELSE category END AS k FROM findings) WHERE k IS NOT NULL GROUP BY ALL),
linked AS (SELECT DISTINCT entity_id, CASE WHEN category = 'leadership' THEN 'staff' ELSE category END AS category, true AS link FROM findings WHERE NOT fetched AND category IN ('staff', 'leadership', 'contact', 'about', 'ministries')),
known AS (SELECT entity_id, bool_or(field_name = '1-URGENT') AS roles, bool_or(field_name = '2-HIGH') AS contact, bool_or(field_name = '5-LOW') AS founded FROM evidence GROUP BY 1),
names AS (SELECT unnest(['homepage', 'staff', 'contact', 'about', 'ministries', 'giving', 'sermons', 'app']) AS category, unnest([true, true, true, true, false, false, false, false]) AS required),
grid AS (SELECT entity_id, names.category, required FROM (SELECT DISTINCT entity_id FROM findings), names),
matrix AS (SELECT g.entity_id, g.category, g.required,
    CASE g.category WHEN 'giving' THEN online_giving WHEN 'app' THEN church_app WHEN 'sermons' THEN p.text_length IS NOT NULL OR youtube OR livestream OR podcast ELSE p.text_length IS NOT NULL OR coalesce(link, false) END AS found,
    p.text_length IS NOT NULL AS fetched, coalesce(p.rendered, false) AS rendered,
    CASE g.category WHEN 'homepage' THEN coalesce(p.text_length > 200, false) WHEN 'staff' THEN p.text_length IS NOT NULL AND coalesce(roles, false) WHEN 'contact' THEN coalesce(contact, false) WHEN 'about' THEN p.text_length IS NOT NULL AND (coalesce(founded, false) OR p.text_length > 300)
      WHEN 'ministries' THEN p.text_length IS NOT NULL WHEN 'giving' THEN online_giving WHEN 'app' THEN church_app ELSE youtube OR livestream OR podcast END AS useful
  FROM grid g LEFT JOIN first_page p USING (entity_id, category) LEFT JOIN linked l USING (entity_id, category) LEFT JOIN known k USING (entity_id) JOIN counted s USING (entity_id))
"""


@registered(COVERAGE_SQL + "SELECT * FROM matrix", "findings", "evidence")
def coverage_matrix(spark, sf):
    return _coverage(spark, sf)[0]


@registered(COVERAGE_SQL + """
, t AS (SELECT entity_id, bool_or(category = 'staff' AND useful) AS su, bool_or(category = 'staff' AND rendered) AS sr, bool_or(category = 'contact' AND useful) AS cu, count(*) FILTER (required AND fetched) AS n FROM matrix GROUP BY 1),
u AS (SELECT entity_id, signals_detected AS d, su, sr, cu, n FROM t JOIN counted USING (entity_id)),
m AS (SELECT entity_id, unnest(['staff_depth_score', 'digital_maturity_score', 'growth_orientation_score', 'change_readiness_score', 'contactability']) AS metric,
  unnest([CASE WHEN su AND sr THEN 'High' WHEN su THEN 'Medium' ELSE 'Low' END, CASE WHEN d >= 4 THEN 'High' WHEN d >= 2 THEN 'Medium' ELSE 'Low' END, CASE WHEN n >= 3 THEN 'High' WHEN n = 2 THEN 'Medium' ELSE 'Low' END, CASE WHEN n >= 3 THEN 'High' WHEN n = 2 THEN 'Medium' ELSE 'Low' END, CASE WHEN cu AND su THEN 'High' WHEN cu OR su THEN 'Medium' ELSE 'Low' END]) AS tier FROM u)
SELECT *, CASE tier WHEN 'High' THEN 76 WHEN 'Medium' THEN 55 ELSE 38 END AS confidence FROM m
""", "findings", "evidence")  # fmt: skip
def score_confidences(spark, sf):
    return coverage.score_confidences(*_coverage(spark, sf))


_SOURCES = " ".join(f"WHEN source_type IN ({', '.join(repr(t) for t in ts)}) THEN '{n}'" for n, ts in coverage.SOURCE_CATEGORIES)


@registered(SIGNALS_SQL + f"""
, hits AS (SELECT entity_id, category, host, min(seq) AS seq, count(*) AS n FROM (
    SELECT entity_id, 'official site' AS category, seq, {_HOST} AS host FROM findings WHERE access_level = 'live_official_site' AND fetched
    UNION ALL SELECT entity_id, c, seq, host FROM (SELECT entity_id, CASE {_SOURCES} END AS c, seq, {_HOST} AS host FROM findings) WHERE c IS NOT NULL) GROUP BY ALL),
agg AS (SELECT entity_id, category, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_slice(list(host ORDER BY seq), 1, 4), ', ') AS hosts FROM hits GROUP BY ALL),
grid AS (SELECT entity_id, c AS category FROM (SELECT DISTINCT entity_id FROM findings), (SELECT unnest(['official site', 'staff page', 'social', 'video/sermons', 'jobs', 'directory/network', 'news/articles', 'app/platform']) AS c))
SELECT g.entity_id, g.category, CASE g.category WHEN 'app/platform' THEN len(platforms) > 0 OR church_app WHEN 'video/sermons' THEN n > 0 OR youtube OR livestream OR podcast ELSE coalesce(n, 0) > 0 END AS present,
       CASE g.category WHEN 'app/platform' THEN len(platforms) ELSE coalesce(n, 0) END AS count, coalesce(hosts, '') AS hosts
FROM grid g LEFT JOIN agg USING (entity_id, category) JOIN counted USING (entity_id)
""", "findings")  # fmt: skip
def source_coverage(spark, sf):
    found = view(spark, sf, "findings")
    return coverage.source_coverage(found, coverage.signals_by_entity(found))


# ---------------------------------------------------------------- calibration

_ARCHETYPE = """CASE WHEN stage = 'relaunch_revitalization' THEN 'Revitalization Church' WHEN attendance > 0 AND online >= 2 * attendance AND coalesce(digital, 0) >= 70 THEN 'Influence Platform' WHEN campuses >= 2 THEN 'Multi-Campus Church'
  WHEN attendance >= 2000 THEN CASE WHEN stage IN ('plateaued', 'declining') THEN 'Plateaued Mega Church' WHEN coalesce(growth, 0) >= 60 THEN 'Growth Church' ELSE 'Healthy Regional Church' END
  WHEN attendance >= 500 THEN CASE WHEN coalesce(growth, 0) >= 60 THEN 'Growth Church' WHEN stage IN ('plateaued', 'declining') THEN 'Institutional Church' ELSE 'Healthy Regional Church' END
  WHEN stage = 'plant' OR (attendance < 200 AND coalesce(growth, 0) >= 55) THEN 'Church Plant' WHEN attendance < 500 THEN CASE WHEN stage = 'declining' THEN 'Reverting Church' ELSE 'Legacy Church' END
  WHEN stage = 'growing' THEN 'Growth Church' WHEN stage = 'plateaued' THEN 'Institutional Church' WHEN stage = 'declining' THEN 'Reverting Church' WHEN stage = 'established' THEN 'Healthy Regional Church' ELSE 'Unclassified' END"""


@registered(f"""SELECT entity_id, {_ARCHETYPE} AS archetype, CAST(least({CAP}, 30 + CASE WHEN attendance IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN campuses IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN stage <> '' THEN 10 ELSE 0 END) AS INT) AS confidence,
  CASE stage WHEN 'plant' THEN 'church_plant' WHEN 'relaunch_revitalization' THEN 'revitalizing' ELSE stage END AS lifecycle FROM profile""", "profile")
def archetype(spark, sf):
    c = F.col
    kind = calibrate.archetype(c("attendance"), c("online"), c("campuses"), c("digital"), c("growth"), c("stage"))
    conf = calibrate.archetype_confidence(c("attendance"), c("campuses"), c("stage"), c("access_level"))
    return view(spark, sf, "profile").select("entity_id", kind.alias("archetype"), conf.alias("confidence"), calibrate.lifecycle_label(c("stage")).alias("lifecycle"))


@registered("SELECT entity_id, CAST(coalesce(sum(w), 0) AS INT) AS contactability FROM (SELECT entity_id, CASE field_name WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 15 WHEN '3-MEDIUM' THEN 20 WHEN '5-LOW' THEN 15 END AS w FROM evidence GROUP BY entity_id, field_name) GROUP BY 1", "evidence")
def contactability(spark, sf):
    name = F.create_map(*(F.lit(x) for x in ("1-URGENT", "lead_pastor", "2-HIGH", "executive_pastor", "3-MEDIUM", "office_email", "5-LOW", "office_phone")))
    return calibrate.contactability(view(spark, sf, "evidence").withColumn("field_name", F.coalesce(name[F.col("field_name")], F.col("field_name"))))


def _num(v: str) -> str:
    unit = f"lower(regexp_extract(replace({v}, ',', ''), '(-?\\d+(?:\\.\\d+)?)\\s*([kKmM])?', 2))"
    return f"TRY_CAST(regexp_extract(replace({v}, ',', ''), '(-?\\d+(?:\\.\\d+)?)', 1) AS DOUBLE) * CASE {unit} WHEN 'k' THEN 1000 WHEN 'm' THEN 1000000 ELSE 1 END"


def _bool(v: str) -> str:
    return f"CASE WHEN lower(trim({v})) IN ('true', 'yes', 'y', '1') THEN true WHEN lower(trim({v})) IN ('false', 'no', 'n', '0') THEN false END"


def _norm(v: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({v}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _equal(a: str, b: str) -> str:
    p, q = _norm(a), _norm(b)
    return f"coalesce(CASE type WHEN 'number' THEN abs(({_num(a)}) - ({_num(b)})) <= greatest(abs({_num(b)}), 1) * coalesce(tol, 0.2) WHEN 'bool' THEN ({_bool(a)}) = ({_bool(b)}) WHEN 'enum' THEN {p} = {q} AND {p} <> '' ELSE {p} <> '' AND {q} <> '' AND ({p} = {q} OR (length({p}) > 2 AND length({q}) > 2 AND (contains({p}, {q}) OR contains({q}, {p})))) END, false)"


def _distance(a: str) -> str:
    return f"CASE WHEN coalesce({a}, '') = '' THEN 'infinity'::DOUBLE WHEN type = 'number' THEN coalesce(abs(({_num(a)}) - ({_num('truth_value')})) / greatest(abs({_num('truth_value')}), 1), 'infinity'::DOUBLE) WHEN {_equal(a, 'truth_value')} THEN 0 ELSE 1 END"


_SPECS = ", ".join(f"({i}, '{k}', '{t}', {'NULL' if tol is None else tol}, {str(m).lower()})" for i, (k, t, tol, m) in enumerate(calibrate.CALIBRATION_FIELDS))
_WIDE = ", ".join(f"max(CASE WHEN source = '{s}' THEN {c} END) AS {s}_{c}" for s in ("tool", "baseline", "truth") for c in ("value", "confidence"))
COMPARE_SQL = f"""
, specs AS (SELECT * FROM (VALUES {_SPECS}) t(field_no, key, type, tol, meta)),
ents AS (SELECT DISTINCT entity_id, CASE entity_id % 3 WHEN 0 THEN 75 WHEN 1 THEN 65 ELSE 95 END AS cap FROM cells),
wide AS (SELECT entity_id, key, {_WIDE} FROM cells GROUP BY ALL),
joined AS (SELECT * FROM (SELECT * FROM ents, specs) LEFT JOIN wide USING (entity_id, key)),
graded AS (SELECT *, CASE WHEN coalesce(truth_value, '') = '' THEN 'unverified' WHEN coalesce(tool_value, '') = '' THEN 'missing' WHEN {_equal('tool_value', 'truth_value')} THEN 'correct' ELSE 'wrong' END AS status, {_distance('tool_value')} AS d, {_distance('baseline_value')} AS e FROM joined),
compared AS (SELECT entity_id, field_no, key, meta, cap, tool_value, baseline_value, truth_value, tool_confidence, baseline_confidence, status,
  status = 'wrong' AND coalesce(tool_confidence, 0) >= 60 AS overconfident, status = 'correct' AND coalesce(tool_confidence, 0) < 50 AS underconfident,
  coalesce(NOT meta AND status = 'correct' AND tool_confidence >= cap - 1, false) AS capped_at_ceiling, coalesce(NOT meta AND status = 'correct' AND baseline_confidence - tool_confidence >= 15, false) AS cap_cost,
  coalesce(NOT meta AND tool_confidence > cap, false) AS cap_violation, CASE WHEN status = 'unverified' THEN 'na' WHEN d < e THEN 'tool' WHEN e < d THEN 'baseline' WHEN isfinite(d) THEN 'tie' ELSE 'na' END AS closer_to_truth FROM graded)
"""


def _compared(spark, sf):
    cells = view(spark, sf, "cells")
    k = F.col("entity_id") % 3
    level = F.when(k == 0, "staff_profile").when(k == 1, "search_snippets").otherwise("live_official_site")
    return calibrate.compare(cells, cells.select("entity_id").distinct().withColumn("access_level", level))


@registered(COMPARE_SQL + "SELECT * FROM compared", "cells")
def calibration_compare(spark, sf):
    return _compared(spark, sf)


@registered(COMPARE_SQL + """
SELECT entity_id, count(*) FILTER (status = 'correct') AS n_correct, count(*) FILTER (status = 'wrong') AS n_wrong, count(*) FILTER (status = 'missing') AS n_missing, count(*) FILTER (overconfident) AS n_overconfident, count(*) FILTER (underconfident) AS n_underconfident,
  count(*) FILTER (capped_at_ceiling) AS n_capped, count(*) FILTER (cap_cost) AS n_cap_cost, count(*) FILTER (cap_violation) AS n_cap_violations, count(*) FILTER (closer_to_truth = 'tool') AS n_tool_closer, count(*) FILTER (closer_to_truth = 'baseline') AS n_baseline_closer,
  bool_or(coalesce(truth_value, '') <> '') AS has_ground_truth FROM compared GROUP BY 1
""", "cells")  # fmt: skip
def calibration_summary(spark, sf):
    return calibrate.summary(_compared(spark, sf))


_BOARDS = [("most_ready", "ready", "DESC"), ("least_ready", "ready", "ASC"), ("most_open", "change", "DESC"), ("most_digital", "digital", "DESC"), ("above_weight", "heavy", "DESC")]


@registered("""
, s AS (SELECT entity_id, seq, change, digital, CASE WHEN growth IS NOT NULL OR change IS NOT NULL THEN coalesce(growth, 0) * 0.5 + coalesce(change, 0) * 0.5 END AS ready, CASE WHEN attendance > 0 THEN digital / greatest(1, log10(attendance + 10)) END AS heavy FROM profile)
""" + " UNION ALL ".join(f"SELECT '{b}' AS board, CAST(row_number() OVER (ORDER BY {c} {w}, seq) AS INT) AS rank, entity_id, CAST({c} AS DOUBLE) AS score FROM s WHERE {c} IS NOT NULL QUALIFY row_number() OVER (ORDER BY {c} {w}, seq) <= 3" for b, c, w in _BOARDS), "profile")
def leaderboards(spark, sf):
    return calibrate.leaderboards(view(spark, sf, "profile"))


@registered("""
SELECT entity_id, array_to_string(list_filter([CASE WHEN site = '' THEN 'no official site' END, CASE WHEN entity_id % 2 = 0 THEN 'missing contact: lead_pastor' END, CASE WHEN entity_id % 3 = 0 THEN 'missing contact: executive_pastor' END, 'missing contact: operations_leader', 'missing contact: communications_leader',
  CASE WHEN entity_id % 5 = 0 THEN 'missing office email' END, CASE WHEN attendance IS NULL THEN 'no attendance estimate' WHEN planting < 50 THEN 'attendance estimate is low-confidence' END, CASE WHEN digital IS NULL THEN 'missing digital score' END, CASE WHEN growth IS NULL THEN 'missing growth score' END,
  CASE WHEN change IS NULL THEN 'missing change score' END, CASE WHEN campuses IS NULL THEN 'missing staff_depth score' END, CASE WHEN access_level <> 'live_official_site' THEN 'capped at ' || access_level END], lambda x: x IS NOT NULL), '; ') AS flags
FROM (SELECT *, CASE WHEN entity_id % 4 = 0 THEN '' ELSE 'u' END AS site FROM profile)
""", "profile")  # fmt: skip
def variance_flags(spark, sf):
    p, k, c = view(spark, sf, "profile"), F.col("entity_id"), F.col
    values = {
        "lead_pastor": F.when(k % 2 != 0, F.lit("x")), "executive_pastor": F.when(k % 3 != 0, F.lit("x")), "operations_leader": F.lit(None), "communications_leader": F.lit(""), "office_email": F.when(k % 5 != 0, F.lit("x")),
        "attendance": c("attendance"), "digital": c("digital"), "growth": c("growth"), "change": c("change"), "staff_depth": c("campuses"),
    }
    flags = calibrate.variance_flags(F.when(k % 4 != 0, F.lit("u")), values, c("planting"), c("access_level"))
    return p.select("entity_id", F.array_join(flags, "; ").alias("flags"))


# ---------------------------------------------------------------- documents, outputs, reports

@registered("""
WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS body FROM documents), i AS (SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS phrase FROM benchmark)
SELECT doc_id, item_id FROM d, i WHERE phrase <> '' AND contains(body, ' ' || phrase || ' ')
""")
def phrase_containment(spark, sf):
    return search.phrase_hits(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


@registered("""
, told AS (SELECT output_id, raw, CASE output_id % 1000 % 5 WHEN 0 THEN regexp_extract(raw, '```json\n(.*)\n```', 1, 's') WHEN 1 THEN raw || '"}' WHEN 2 THEN '{"a": [1, 2, {"b": "c"}]}' WHEN 4 THEN split_part(raw, ' and {"more"', 1) END AS json FROM outputs)
SELECT output_id, json, CASE WHEN json IS NULL THEN 'no JSON in the output' END AS error, CAST(ceil(length(raw) / 4) AS BIGINT) AS tokens FROM told
""", "outputs")  # fmt: skip
def json_repair(spark, sf):
    return jsonfix.parse_outputs(view(spark, sf, "outputs")).select("output_id", "json", "error", jsonfix.token_estimate(F.col("raw")).alias("tokens"))


@registered()
def coerce_synthesis(spark, sf):
    parsed = jsonfix.parse_outputs(view(spark, sf, "outputs")).where("json is not null")
    return jsonfix.synthesis(parsed).select("output_id", "lifecycle_stage", "church_app_status", "staff_count", "growth_orientation_score", "digital_maturity_score", "change_readiness_score", "lead_pastor")


@registered()
def synthesis_fields(spark, sf):
    parsed = jsonfix.parse_outputs(view(spark, sf, "outputs")).where("json is not null")
    return jsonfix.synthesis_fields(parsed, "output_id")


def _roster_text(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    letters = F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij")
    name = F.concat(F.lit("Dr. Ann"), letters, F.lit(" Lee"), letters)
    k = F.col("s_suppkey") % 4
    title = F.when(k == 0, "Lead Pastor").when(k == 1, "Executive Pastor").when(k == 2, "Director of Operations").otherwise("Next Gen")
    text = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Home\n"), name, F.lit(" — "), title, F.lit("\nGive"))).otherwise(F.concat(F.lit("Menu\n"), name, F.lit("\n"), title, F.lit("\nA long line of a life that ends with a stop.\nBob Stone\nnothing")))
    return s.select("s_suppkey", text.alias("inner_text"))


@registered("""
WITH t AS (SELECT s_suppkey, translate(CAST(s_suppkey AS STRING), '0123456789', 'abcdefghij') AS l, CASE s_suppkey % 4 WHEN 0 THEN 'Lead Pastor' WHEN 1 THEN 'Executive Pastor' WHEN 2 THEN 'Director of Operations' ELSE 'Next Gen' END AS title FROM supplier)
SELECT s_suppkey, CAST(0 AS INT) AS card_seq, 'Ann' || l || ' Lee' || l AS name, title, CASE title WHEN 'Lead Pastor' THEN 'lead_pastor' WHEN 'Executive Pastor' THEN 'executive_pastor' WHEN 'Director of Operations' THEN 'operations_leader' END AS role_field,
       CAST(CASE title WHEN 'Lead Pastor' THEN 80 WHEN 'Executive Pastor' THEN 80 WHEN 'Director of Operations' THEN 78 END AS DOUBLE) AS role_confidence FROM t
""")
def staff_cards(spark, sf):
    return staff.staff_cards(_roster_text(spark, sf), "s_suppkey")


@registered(f"""
, best AS (SELECT entity_id, field_name, value, confidence FROM evidence QUALIFY row_number() OVER (PARTITION BY entity_id, field_name ORDER BY reliability * confidence DESC, seq) = 1),
l AS (SELECT entity_id AS id, string_agg('- ' || field_name || ': ' || value || ' (' || CAST(CAST(confidence AS INT) AS STRING) || ')', chr(10) ORDER BY field_name) AS lines FROM best GROUP BY 1)
SELECT id, '# ' || name || chr(10) || coalesce(lines, '(no facts)') AS markdown FROM entities LEFT JOIN l USING (id)
""", "entities", "evidence")  # fmt: skip
def report_markdown(spark, sf):
    return report.fact_report(view(spark, sf, "entities"), facts.best_facts(view(spark, sf, "evidence")))


@registered(f"SELECT DISTINCT c.entity_id, s.key, CAST(NULL AS STRING) AS value FROM cells c, (VALUES {_SPECS}) s(field_no, key, type, tol, meta) WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.entity_id = c.entity_id AND x.key = s.key)", "cells")
def template_scaffold(spark, sf):
    cells = view(spark, sf, "cells")
    return report.scaffold(cells.select("entity_id").distinct(), calibrate.field_specs(spark), cells.select("entity_id", "key").distinct())


@registered("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, CAST(floor(sum(value) * 10000 + 0.5) / 10000 AS DOUBLE) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """The streaming counts' plan over a finished table."""
    out = evidence_log.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", C.rounded(F.col("total"), 4).alias("total"))


@registered(f"SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'inference' WHEN {_HOST} = '' THEN 'unknown' WHEN page_id % 2 = 0 THEN 'official_site' ELSE 'directory' END AS source_type FROM site_pages", "site_pages")
def evidence_source_types(spark, sf):
    p = view(spark, sf, "site_pages")
    official = F.when(F.col("page_id") % 2 == 0, U.origin_of(F.col("url")))
    return p.select("page_id", U.source_type(F.col("url"), official).alias("source_type"))


# ---------------------------------------------------------------- collection and discovery

_ENT = f"replace(replace(replace(replace(replace(replace({{x}}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')"


def _body_sql() -> str:
    x = "regexp_replace(regexp_replace(html, '(?is)^.*?<body[^>]*>', ''), '(?is)</body>.*$', '')"
    for tag in H.HIDDEN:
        x = f"regexp_replace({x}, '(?is)<{tag}.*?</{tag}>', ' ', 'g')"
    return _spaced_sql(_ENT.format(x=f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"))


@registered(f"SELECT page_id, {_body_sql()} AS body FROM site_pages", "site_pages")
def html_body_text(spark, sf):
    return view(spark, sf, "site_pages").select("page_id", H.extract_text(F.col("html")).alias("body"))


_ORIGIN = "lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"
_TARGET = "regexp_replace(href, '#.*$', '')"
_ABSOLUTE = (
    f"CASE WHEN regexp_matches({_TARGET}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_TARGET} WHEN starts_with({_TARGET}, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || {_TARGET} "
    f"WHEN starts_with({_TARGET}, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || {_TARGET} "
    f"ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/') || {_TARGET} END"
)


@registered(LINKS_SQL + f"SELECT page_id, link_seq, target, {_ORIGIN.format(x='target')} <> '' AND {_ORIGIN.format(x='target')} = {_ORIGIN.format(x='url')} AS internal FROM (SELECT *, {_ABSOLUTE} AS target FROM kept)", "site_pages")
def links_resolved(spark, sf):
    out = _links(spark, sf).withColumn("target", U.resolve(F.col("href"), F.col("url")))
    return out.select("page_id", "link_seq", "target", U.same_origin(F.col("target"), F.col("url")).alias("internal"))


_HOSTS_SQL = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate([
    "https://www.facebook.com/x", "https://youtu.be/1", "https://indeed.com/j", "https://www.google.com/maps/p", "https://yelp.com/b", "https://x.org/directory/1", "https://ohdistrict.org/", "https://bigbuilders.com/p", "https://www.tribune.com/a", "https://own.org/about",
])) + " ELSE 'https://plain.example.org/' END"
_CLASSES = " ".join(f"WHEN regexp_matches({ {'host': 'host', 'path': 'path', 'both': 'host || path'}[w]}, '{p}') THEN '{k}|{r}'" for w, p, k, r in U.RESULT_CLASSES)


@registered(f"SELECT doc_id, split_part(k, '|', 1) AS source_type, CASE WHEN split_part(k, '|', 1) = 'vendor_reference' THEN 'vendor_reference' ELSE 'search_snippets' END AS access_level, CAST(split_part(k, '|', 2) AS DOUBLE) AS reliability FROM (SELECT doc_id, CASE WHEN host = 'own.org' THEN 'official_site|0.62' {_CLASSES} ELSE 'search|0.5' END AS k FROM (SELECT doc_id, {_HOST} AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)) AS path FROM (SELECT doc_id, {_HOSTS_SQL} AS url FROM documents)))")
def result_classes(spark, sf):
    urls = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.expr(_HOSTS_SQL).alias("url"))
    return urls.select("doc_id", U.classify_result(F.col("url"), F.lit("own.org")).alias("k")).select("doc_id", "k.*")


@registered(f"SELECT doc_id, regexp_matches(text, '{X.EMAIL}') OR regexp_matches(text, '{X.PHONE}') OR regexp_matches(text, '(?i)\\b(lead|senior|associate|executive|founding)\\s+pastor\\b') AS signal FROM texts", "texts")
def contact_signals(spark, sf):
    return _texts(spark, sf).select("doc_id", H.has_contact_signal(F.col("text")).alias("signal"))


def _findings(spark, sf):
    # 25 pages and 25 results to an entity, however many there are
    pages = view(spark, sf, "site_pages").select(
        F.floor(F.col("page_id") / 25).alias("entity_id"), F.col("page_id").alias("seq"), "url", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200).alias("status"),
        F.get(F.array(*(F.lit(x) for x in ("home", "staff", "contact", "about", "sermons"))), (F.col("page_id") % 5).cast("int")).alias("category"), "html",
    )
    results = _texts(spark, sf).select(F.floor(F.col("doc_id") / 25).alias("entity_id"), (F.col("doc_id") + 1_000_000).alias("seq"), F.expr(_HOSTS_SQL).alias("url"), F.lit("Result").alias("title"), F.col("text").alias("snippet"), F.lit("own.org").alias("official_host"))
    return collect.website_findings(pages).unionByName(collect.snippet_findings(results))


@registered()
def findings_collected(spark, sf):
    """Findings of pages and snippets with the number of their fields."""
    return _findings(spark, sf).select("entity_id", "seq", "source_type", "access_level", "fetched", F.size("fields").alias("n_fields"))


@registered()
def dossiers(spark, sf):
    """The research result of each entity, from findings to confidence."""
    return collect.dossiers(staged(_findings(spark, sf), "findings")).drop("lead_pastor")


def _targets(spark, sf):
    name = F.concat(F.lit("Harbor Qx"), (F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij")), F.lit(" Church"))
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    slug = F.concat(F.lit("harborqx"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"))
    return s.select(
        F.col("s_suppkey").alias("entity_id"), name.alias("name"), F.lit("Lima").alias("city"), F.lit("OH").alias("state"),
        F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("www."), slug, F.lit(".org"))).alias("website"), F.lit(None).cast("string").alias("alternative"), slug.alias("slug"),
    )


@registered("""
WITH t AS (SELECT s_suppkey, s_suppkey % 4 AS k, 'harborqx' || translate(CAST(s_suppkey AS STRING), '0123456789', 'abcdefghij') || '.org' AS host FROM supplier)
SELECT s_suppkey AS entity_id, CASE WHEN k <> 0 THEN host END AS official_host FROM t
""")
def discover_sites(spark, sf):
    """The chosen site of each target: its own where a page bears its name."""
    targets = _targets(spark, sf)
    k = F.col("entity_id") % 4
    words = F.repeat(F.concat(F.lit("sunday worship service times "), F.col("name"), F.lit(" ")), 20)
    html = F.concat(F.lit("<title>"), F.when(k == 3, F.lit("Other Place")).otherwise(F.col("name")), F.lit("</title><p>Lima "), F.when(k == 3, F.repeat(F.lit("worship and more words "), 20)).otherwise(words), F.lit("</p>"))
    sites = discover.inspect(targets.select(F.concat("slug", F.lit(".org")).alias("host"), F.when(k == 0, 404).otherwise(200).alias("status"), html.alias("html")))
    results = targets.select("entity_id", F.lit(1).alias("rank"), F.concat(F.lit("https://yelp.com/biz/"), "slug").alias("url"))
    every = staged(discover.candidates(targets, staged(discover.seeds(targets, results), "seeds"), staged(sites, "sites")), "candidates")
    out = discover.official_sites(targets, every)
    return out.select("entity_id", F.nullif(U.host_of(F.col("official_site")), F.lit("")).alias("official_host"))
