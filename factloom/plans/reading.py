"""Registered queries on result pages and on findings as context."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import batches, context, result_pages
from factloom.plans.catalogue import registered
from factloom.sources.fixtures import view

# What the pages say, by the rule that they are made by.
_RESULTS = """
, made AS (SELECT page_id, provider, i, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS no FROM (SELECT *, unnest(range(0, CAST(least(4, page_id % 5) AS BIGINT))) AS i FROM result_pages WHERE body IS NOT NULL) WHERE NOT (provider = 'duckduckgo-html' AND i = 2)),
told AS (SELECT page_id, provider, CAST(no AS INTEGER) AS result_no, 'https://s' || CAST(page_id AS VARCHAR) || '.example.org/' || CAST(i AS VARCHAR) AS url, 'Site ' || CAST(page_id AS VARCHAR) || ' & more ' || CAST(i AS VARCHAR) AS title,
    CASE provider WHEN 'duckduckgo-html' THEN 'Words of ' || CAST(page_id AS VARCHAR) || ' here' ELSE '' END AS snippet FROM made)
"""


@registered(_RESULTS + "SELECT * FROM told", "result_pages")
def result_page_results(spark, sf):
    return result_pages.results(result_pages.read_pages(view(spark, sf, "result_pages")))


@registered(_RESULTS + """
SELECT page_id, p.provider, coalesce(status, 0) AS status, CAST(coalesce(n, 0) AS INTEGER) AS result_count, coalesce(n, 0) > 0 AS ok, note FROM result_pages p LEFT JOIN (SELECT page_id, count(*) AS n FROM told GROUP BY 1) USING (page_id)
""", "result_pages")  # fmt: skip
def result_page_diagnostics(spark, sf):
    return result_pages.diagnostics(result_pages.read_pages(view(spark, sf, "result_pages")))


@registered("""
, shown AS (SELECT entity_id, seq, '- [' || source_type || ' | access=' || access_level || ' | fetched=' || CASE WHEN fetched THEN 'true' ELSE 'false' END || ' | rel=' || CASE access_level WHEN 'live_official_site' THEN '0.95' WHEN 'search_snippets' THEN '0.5' ELSE '1' END || '] ' || url
    || chr(10) || '   title: ' || title || chr(10) || '   text: ' || CASE source_type WHEN 'staff_page' THEN repeat(body || ' ', 60)[:1500] ELSE repeat(body || ' ', 60)[:400] END || CASE WHEN seq % 5 = 0 THEN chr(10) || '   extracted: phone=330; email=null' ELSE '' END AS line FROM findings),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY entity_id ORDER BY seq, line ROWS UNBOUNDED PRECEDING) - length(line) - 1 AS begin FROM shown)
SELECT entity_id, string_agg(line, chr(10) ORDER BY seq, line)[:8000] AS context, count(*) AS n_findings FROM placed WHERE begin < 8000 GROUP BY 1
""", "findings")  # fmt: skip
def context_findings(spark, sf):
    """What of an entity's findings fits into a question."""
    f = view(spark, sf, "findings")
    text = F.repeat(F.concat("body", F.lit(" ")), 60)
    rel = F.when(F.col("access_level") == "live_official_site", 0.95).when(F.col("access_level") == "search_snippets", 0.5).otherwise(1.0)
    fields = F.when(F.col("seq") % 5 == 0, F.from_json(F.lit('[{"field_name": "phone", "value": "330"}, {"field_name": "email"}]'), "array<struct<field_name: string, value: string>>"))
    return context.findings_context(f.withColumns({"text": text, "snippet": text, "reliability": rel, "fields": fields}))


@registered("""
, entries AS (SELECT DISTINCT entity_id FROM cells), tool AS (SELECT entity_id, count(*) FILTER (value IS NOT NULL) AS row FROM cells WHERE source = 'tool' AND entity_id % 3 <> 0 GROUP BY 1),
truth AS (SELECT entity_id, count(*) FILTER (coalesce(value, '') <> '') AS expected FROM cells WHERE source = 'truth' AND entity_id % 4 <> 0 GROUP BY 1)
SELECT entity_id, row, expected, CASE WHEN row IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unchecked' ELSE 'ready' END AS status FROM entries LEFT JOIN tool USING (entity_id) LEFT JOIN truth USING (entity_id)
""", "cells")  # fmt: skip
def calibration_status(spark, sf):
    """The calibration set beside its computed rows and what is expected of them."""
    cells = view(spark, sf, "cells")
    of = lambda source, skip, column, there: cells.where((F.col("source") == source) & (F.col("entity_id") % skip != 0)).groupBy("entity_id").agg(F.count_if(there).alias(column))
    rows, truth = of("tool", 3, "row", F.col("value").isNotNull()), of("truth", 4, "expected", F.coalesce("value", F.lit("")) != "")
    return batches.calibration_status(cells.select("entity_id").distinct(), rows, truth)
