"""Registered queries on a site's links and on what to probe."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import urls as U
from factloom.operators import crawl
from factloom.plans.catalogue import _CATEGORY, LINKS_SQL, _links, registered
from factloom.sources.fixtures import view
from factloom.sources.staging import staged

_ORIGIN = "lower(regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1))"
LINKED_SQL = LINKS_SQL + rf"""
, based AS (SELECT k.page_id AS entity_id, k.link_seq, k.href, k.text, s.url AS base, regexp_replace(s.url, '[?#].*$', '') AS stem, {_ORIGIN.format("s.url")} AS origin, regexp_replace(regexp_replace(k.href, '#.*$', ''), '^(\./)+', '') AS h
           FROM kept k JOIN site_pages s USING (page_id) WHERE NOT regexp_matches(k.href, '^(mailto|tel|javascript|data):', 'i')),
made AS (SELECT *, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(base, '^([A-Za-z]+:)', 1) || h WHEN starts_with(h, '/') THEN origin || h WHEN h = '' THEN regexp_replace(base, '#.*$', '')
                WHEN starts_with(h, '?') THEN stem || h WHEN regexp_matches(stem, '^[^/]+//[^/]+/') THEN regexp_extract(stem, '^(.*/)', 1) || h ELSE origin || '/' || h END AS m FROM based),
found AS (SELECT *, CASE WHEN {_ORIGIN.format("m")} = '' THEN m ELSE {_ORIGIN.format("m")} || regexp_replace(regexp_replace(m, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+', ''), '^$', '/') END AS resolved FROM made),
held AS (SELECT *, {_ORIGIN.format("resolved")} = origin AS same_origin, lower(regexp_extract(resolved, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1) || ' ' || text) AS hay FROM found),
named AS (SELECT *, CASE WHEN same_origin THEN {_CATEGORY} END AS category FROM held),
marked AS (SELECT *, category IS NOT NULL AND row_number() OVER (PARTITION BY entity_id, category ORDER BY link_seq) = 1 AS selected FROM named),
visits AS (SELECT DISTINCT entity_id, resolved AS url, length(resolved) % 4 <> 0 AS ok, length(resolved) * 10 AS text_length FROM marked WHERE length(resolved) % 3 <> 0)
"""  # fmt: skip


def _linked(spark, sf):
    # pages are parsed once
    rows = staged(_links(spark, sf).select(F.col("page_id").alias("entity_id"), "link_seq", "href", "text", F.col("url").alias("base")), "links")
    size = F.length("url")
    visited = rows.select("entity_id", U.link_target(F.col("base"), F.col("href")).alias("url")).where(~F.col("url").rlike("(?i)^(mailto|tel|javascript|data):")).distinct()
    return rows, visited.where(size % 3 != 0).select("entity_id", "url", (size % 4 != 0).alias("ok"), (size * 10).alias("text_length"))


@registered(LINKED_SQL + """
, first AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY entity_id, resolved ORDER BY link_seq) = 1),
picked AS (SELECT DISTINCT entity_id, resolved FROM marked WHERE selected)
SELECT f.entity_id, f.link_seq, f.href, f.text, f.resolved, f.same_origin, f.category, f.selected, v.url IS NOT NULL AS fetched, CAST(coalesce(v.text_length, 0) AS INT) AS text_length
FROM first f LEFT JOIN picked p ON p.entity_id = f.entity_id AND p.resolved = f.resolved LEFT JOIN visits v ON v.ok AND v.entity_id = p.entity_id AND v.url = p.resolved
""", "site_pages")  # fmt: skip
def link_diagnostics(spark, sf):
    return crawl.link_diagnostics(*_linked(spark, sf))


@registered(f"""
, sites AS (SELECT page_id AS entity_id, {_ORIGIN.format("url")} AS origin FROM site_pages),
visits AS (SELECT entity_id, 1 AS n, origin || '/staff' AS url, origin || '/our-team' AS final_url, entity_id % 2 = 0 AS ok, 'staff' AS category FROM sites WHERE entity_id % 3 = 0
           UNION ALL SELECT entity_id, 2, origin || '/contact', origin || '/contact', true, CASE WHEN entity_id % 5 = 0 THEN 'leadership' ELSE 'contact' END FROM sites WHERE entity_id % 4 <> 1),
tries AS (SELECT * FROM (VALUES (0, 'staff', '/staff', 'staff'), (1, 'staff', '/team', NULL), (2, 'staff', '/leadership', NULL), (3, 'staff', '/our-team', NULL), (4, 'contact', '/contact', NULL), (5, 'contact', '/connect', NULL), (6, 'about', '/about', NULL), (7, 'about', '/about-us', NULL), (8, 'about', '/who-we-are', NULL)) t(place, kind, path, unused)),
open AS (SELECT s.entity_id, t.place, t.kind, s.origin || t.path AS url, t.path || ' ' AS hay FROM sites s, tries t
         WHERE NOT EXISTS (SELECT 1 FROM visits v WHERE v.entity_id = s.entity_id AND v.ok AND (v.category = t.kind OR (t.kind = 'staff' AND v.category = 'leadership')))
           AND NOT EXISTS (SELECT 1 FROM visits v WHERE v.entity_id = s.entity_id AND s.origin || t.path IN (v.url, v.final_url)))
SELECT entity_id, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY place) AS INT) AS probe_no, url, coalesce({_CATEGORY}, kind) AS category FROM open QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY place) <= 6
""", "site_pages")  # fmt: skip
def site_probes(spark, sf):
    e, o = F.col("entity_id"), F.col("origin")
    sites = view(spark, sf, "site_pages").select(F.col("page_id").alias("entity_id"), U.origin_of(F.col("url")).alias("origin"))
    staff = sites.where(e % 3 == 0).select("entity_id", F.concat(o, F.lit("/staff")).alias("url"), F.concat(o, F.lit("/our-team")).alias("final_url"), (e % 2 == 0).alias("ok"), F.lit("staff").alias("category"))
    contact = F.concat(o, F.lit("/contact"))
    other = sites.where(e % 4 != 1).select("entity_id", contact.alias("url"), contact.alias("final_url"), F.lit(True).alias("ok"), F.when(e % 5 == 0, "leadership").otherwise("contact").alias("category"))
    return crawl.probes(sites, staff.unionByName(other))
