"""Logical tables derived from the driver's tables, as SQL that Spark and DuckDB
both run. Text that those tables lack (contacts, links, roles) is put in by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "entities": ["customer", "nation"],
    "evidence": ["orders"],
    "queue": ["orders"],
    "findings": ["supplier", "lineitem"],
    "fields": ["lineitem"],
    "runs": ["events"],
    "texts": ["documents"],
    "site_pages": ["pages"],
    "results": ["pages"],
    "proposals": ["orders", "customer"],
    "cells": ["labels"],
    "roster": ["customer"],
    "robots": ["nation"],
    "robot_urls": ["supplier"],
    "candidates": ["supplier", "part"],
    "profile": ["customer"],
    "outputs": ["conversations"],
    "answers": ["conversations"],
    "bundles": ["pages"],
    "result_pages": ["pages"],
    "dossier_entities": ["supplier"],
    "dossier_facts": ["lineitem"],
    "dossier_sites": ["lineitem"],
    "dossier_roles": ["lineitem"],
    "builds": ["customer"],
    "run_starts": ["events"],
    "run_ends": ["events"],
}



def _result_page() -> str:
    """SQL of pages as four providers write them, with up to four results: the second of
    each page links directly, the third of the first provider has no link, and some
    pages of the last provider have titles only."""
    n = "CAST(page_id AS STRING)"
    made = []
    for i in range(4):
        title = f"'Site <b>' || {n} || '</b> &amp; more {i}'"
        plain = f"'https://s' || {n} || '.example.org/{i}'"
        href = f"'//s' || {n} || '.example.org/{i}'" if i == 1 else f"'//duckduckgo.com/l/?uddg=https%3A%2F%2Fs' || {n} || '.example.org%2F{i}&rut=x'"
        first = "'<div class=\"result__body\">no link</div>'" if i == 2 else f"'<div class=\"result__body\"><a rel=\"nofollow\" class=\"result__a\" href=\"' || {href} || '\">' || {title} || '</a> <a class=\"result__snippet\" href=\"#\">Words  of <b>' || {n} || '</b>&nbsp;here</a></div>'"
        second = f"'<a rel=\"nofollow\" class=\"result-link\" href=\"' || {href} || '\">' || {title} || '</a><br>'"
        third = f"'<li class=\"b_algo\"><div>x</div><h2> <a target=\"_blank\" href=\"' || {plain} || '\">' || {title} || '</a></h2><p>y</p></li>'"
        fourth = f"CASE WHEN page_id % 3 = 0 THEN '' ELSE '<a class=\"ob\" href=\"' || {plain} || '\">u</a><h2>' END || '<a class=\"title\" href=\"' || {plain} || '\">' || {title} || '</a>'"
        made.append(f"CASE WHEN page_id % 5 <= {i} THEN '' ELSE CASE page_id % 4 WHEN 0 THEN {first} WHEN 1 THEN {second} WHEN 2 THEN {third} ELSE {fourth} END END")
    return " || ".join(made)


VIEWS = {
    "dossier_entities": """
SELECT s_suppkey AS entity_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Lima' END AS city, 'OH' AS state, CASE s_suppkey % 3 WHEN 0 THEN 'true_match' WHEN 1 THEN 'uncertain' ELSE 'no_match' END AS identity_verdict,
       'https://org' || CAST(s_suppkey AS STRING) || '.example.org' AS identity_site, CASE WHEN s_suppkey % 10 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(40 + s_suppkey % 61 AS DOUBLE) END AS identity_confidence, 'search' AS method,
       CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'https://org' || CAST(s_suppkey AS STRING) || '.example.org' END AS official_site, CASE WHEN s_suppkey % 3 = 1 THEN 'Ann Lee' END AS lead_pastor,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 'Network ' || CAST(s_suppkey % 6 AS STRING) END AS denomination, CASE s_suppkey % 3 WHEN 0 THEN 'plant' WHEN 1 THEN 'growing' ELSE 'unknown' END AS lifecycle_stage,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey * 31 % 140 - 20 AS DOUBLE) END AS growth_orientation_score, CAST(s_suppkey * 17 % 101 AS DOUBLE) AS digital_maturity_score, CASE WHEN s_suppkey % 2 = 0 THEN CAST(50 AS DOUBLE) END AS change_readiness_score,
       CAST(s_suppkey % 120 AS DOUBLE) AS staff_depth_score, CASE WHEN s_suppkey % 8 = 3 THEN NULL ELSE CAST(s_suppkey * 37 % 6000 AS DOUBLE) END AS attendance, CAST(s_suppkey % 101 AS DOUBLE) AS attendance_confidence,
       CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey * 11 % 900 AS DOUBLE) END AS online_attendance_estimate, CAST(s_suppkey * 7 % 101 AS DOUBLE) AS online_attendance_confidence, CASE s_suppkey % 3 WHEN 0 THEN 'active' ELSE 'unknown' END AS app_status,
       CASE WHEN s_suppkey % 4 = 1 THEN 'Subsplash' END AS app_provider, CASE WHEN s_suppkey % 2 = 1 THEN 'Live every week' ELSE 'A page' END AS digital_summary, CASE WHEN s_suppkey % 9 <> 0 THEN CAST(s_suppkey % 40 AS DOUBLE) END AS staff_count,
       CAST(s_suppkey % 4 * 20 AS DOUBLE) AS staff_count_confidence, CASE WHEN s_suppkey % 2 = 0 THEN CAST(2 AS DOUBLE) END AS campus_count, CAST(0 AS DOUBLE) AS campus_count_confidence
FROM supplier""",
    "dossier_facts": """
SELECT l_suppkey AS entity_id, CASE l_partkey % 14 WHEN 0 THEN 'lead_pastor' WHEN 1 THEN 'office_email' WHEN 2 THEN 'office_phone' WHEN 3 THEN 'executive_pastor' WHEN 4 THEN 'multi_site' WHEN 5 THEN 'founded_year' WHEN 6 THEN 'app_provider' WHEN 7 THEN 'instagram_followers'
            WHEN 8 THEN 'online_giving_present' WHEN 9 THEN 'years_active' ELSE CASE WHEN l_suppkey % 2 = 1 THEN 'staff_count' ELSE 'operations_leader' END END AS field_name, 'f' || CAST(l_partkey % 7 AS STRING) AS value, CAST(40 + l_orderkey % 50 AS DOUBLE) AS confidence,
       CASE l_returnflag WHEN 'A' THEN CAST(0.95 AS DOUBLE) WHEN 'N' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS reliability, CASE l_returnflag WHEN 'A' THEN 'live_official_site' WHEN 'N' THEN 'search_snippets' ELSE 'staff_profile' END AS access_level,
       'https://f' || CAST(l_partkey % 5 AS STRING) || '.example.org' AS source_url, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq
FROM lineitem WHERE l_partkey % 3 = l_suppkey % 3""",
    "dossier_sites": """
SELECT l_suppkey AS entity_id, 'h' || CAST(l_partkey % 5 AS STRING) || '.example.org' AS host, 'https://h' || CAST(l_partkey % 5 AS STRING) || '.example.org/' || CAST(l_linenumber AS STRING) AS url, l_quantity > 45 AS name_full,
       CASE l_returnflag WHEN 'A' THEN 'conflict' WHEN 'N' THEN 'match' ELSE 'unknown' END AS place, CASE WHEN l_linenumber % 2 = 0 THEN 'official' ELSE 'unknown' END AS kind, CASE l_linestatus WHEN 'F' THEN 'search' ELSE 'domain_guess' END AS source
FROM lineitem WHERE l_suppkey % 3 <> 1""",
    "dossier_roles": """
SELECT l_suppkey AS entity_id, 'lead_pastor_role' AS key, CASE l_partkey % 3 WHEN 0 THEN 'Lead Pastor' WHEN 1 THEN 'lead pastor' ELSE 'Senior Pastor' END AS value, CASE WHEN l_partkey % 3 < 2 THEN 'lead' ELSE 'senior' END AS norm,
       CASE l_returnflag WHEN 'A' THEN 'live_official_site' WHEN 'N' THEN 'search_snippets' ELSE 'staff_profile' END AS access_level, CASE l_returnflag WHEN 'A' THEN CAST(0.95 AS DOUBLE) WHEN 'N' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS reliability,
       (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq
FROM lineitem WHERE l_suppkey % 5 <> 0""",
    "result_pages": f"""
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'duckduckgo-html' WHEN 1 THEN 'duckduckgo-lite' WHEN 2 THEN 'bing' ELSE 'mojeek' END AS provider, CASE WHEN page_id % 11 <> 0 THEN 200 END AS status, CASE WHEN page_id % 11 = 0 THEN 'timeout' END AS note,
       CASE WHEN page_id % 11 <> 0 THEN '<html><body>' || {_result_page()} || '</body></html>' END AS body
FROM pages""",
    "entities": """
SELECT c_custkey AS id, 'row-' || CAST(c_custkey AS STRING) AS original_row_id, c_name AS name, n_name AS state,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'Verified Active' WHEN 'AUTOMOBILE' THEN 'Likely Active' WHEN 'MACHINERY' THEN 'Uncertain'
            WHEN 'HOUSEHOLD' THEN 'Likely Inactive' ELSE 'Closed' END AS active_status,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE least(CAST(100 AS DOUBLE), c_acctbal / 100) END AS fit_score,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE 'https://www.org' || CAST(c_custkey AS STRING) || '.example.org/about' END AS website,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'info@org' || CAST(c_custkey AS STRING) || '.example.org' END AS email,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Lead ' || CAST(c_custkey AS STRING) END AS lead_name,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS last_checked_at
FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "evidence": """
SELECT o_custkey AS entity_id, o_orderpriority AS field_name, 'v' || CAST(o_orderkey % 7 AS STRING) AS value,
       CASE o_orderstatus WHEN 'F' THEN 'live_official_site' WHEN 'O' THEN 'search_snippets' ELSE 'third_party_directory' END AS access_level,
       CASE o_orderstatus WHEN 'F' THEN CAST(0.95 AS DOUBLE) WHEN 'O' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.78 AS DOUBLE) END AS reliability,
       CAST(45 + o_orderkey % 45 AS DOUBLE) AS confidence, o_orderkey AS seq
FROM orders""",
    "queue": """
SELECT o_orderkey AS id, o_custkey AS entity_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'staff_count' WHEN '2-HIGH' THEN 'denomination' WHEN '3-MEDIUM' THEN 'attendance_estimate' WHEN '5-LOW' THEN 'lead_pastor' ELSE 'website_verified' END AS field_name,
       CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 400 AS STRING) || ' [1-2]' ELSE CAST(o_orderkey % 400 AS STRING) END AS proposed_value,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(60 + o_orderkey % 25 AS DOUBLE) END AS confidence,
       CASE o_orderkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'approved' WHEN 3 THEN 'rejected' ELSE 'needs_more_research' END AS review_status,
       o_orderkey AS seq
FROM orders""",
    "findings": """
SELECT l_suppkey AS entity_id, (l_orderkey * 10 + l_linenumber) * 10000000 + l_partkey AS seq,
       CASE l_linenumber WHEN 1 THEN 'official_site' WHEN 2 THEN 'staff_page' WHEN 3 THEN 'facebook' WHEN 4 THEN 'youtube' WHEN 5 THEN 'job_posting' WHEN 6 THEN 'denom_directory' ELSE 'news_media' END AS source_type,
       CASE l_returnflag WHEN 'A' THEN 'live_official_site' WHEN 'N' THEN 'search_snippets' ELSE 'staff_profile' END AS access_level,
       l_linestatus = 'F' AS fetched,
       CASE l_linenumber WHEN 1 THEN 'home' WHEN 2 THEN 'staff' WHEN 3 THEN 'contact' WHEN 4 THEN 'about' WHEN 5 THEN 'ministries' WHEN 6 THEN 'sermons' ELSE 'leadership' END AS category,
       l_quantity > 25 AS rendered, CAST(l_quantity * 12 AS INT) AS text_length,
       'https://www.host' || CAST(l_partkey % 9 AS STRING) || '.example.org/p' AS url,
       CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'Give online with Pushpay' WHEN 1 THEN 'watch live every week' WHEN 2 THEN 'our podcast' WHEN 3 THEN 'download our app' ELSE 'plain words' END AS body,
       'Page ' || CAST(l_linenumber AS STRING) AS title
FROM lineitem""",
    "fields": """
SELECT l_suppkey * 10 + l_linenumber AS entity_id, 'phone' AS key,
       '(330) 555-01' || CAST(10 + l_partkey % 2 AS STRING) AS value,
       CASE l_returnflag WHEN 'A' THEN 'live_official_site' WHEN 'N' THEN 'search_snippets' ELSE 'staff_profile' END AS access_level,
       CASE l_returnflag WHEN 'A' THEN CAST(0.95 AS DOUBLE) WHEN 'N' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS reliability,
       l_orderkey * 10000000 + l_partkey AS seq
FROM lineitem""",
    "runs": """
SELECT event_type AS run_type, CASE WHEN value < 5 THEN 'failed' ELSE 'completed' END AS status, event_id % 1000 AS tokens_in, event_id % 300 AS tokens_out
FROM events""",
    "texts": """
SELECT doc_id, 'https://www.site' || CAST(doc_id % 50 AS STRING) || '.example.org/' || CASE doc_id % 9 WHEN 0 THEN 'give' ELSE 'page' END AS url,
       CASE doc_id % 12
            WHEN 0 THEN 'Founded in 19' || CAST(10 + doc_id % 80 AS STRING) || '. '
            WHEN 1 THEN 'We celebrated ' || CAST(5 + doc_id % 90 AS STRING) || ' years in 2019. '
            WHEN 2 THEN 'With ' || CAST(2 + doc_id % 6 AS STRING) || ' campuses and a team of ' || CAST(doc_id % 60 AS STRING) || '. '
            WHEN 3 THEN 'One location, online giving by Tithe.ly. '
            WHEN 4 THEN 'Download our app from Subsplash. '
            WHEN 5 THEN 'Lead Pastor: John Adams of the north. '
            WHEN 6 THEN 'Mary Jones, Executive Pastor here. '
            WHEN 7 THEN 'Write to anna@site.example.org or office@site.example.org. '
            WHEN 8 THEN 'Call (330) 555-' || CAST(1000 + doc_id % 9000 AS STRING) || ' now. '
            WHEN 9 THEN 'Three locations. Our page has 12,5k followers. '
            WHEN 10 THEN 'No mobile app yet; 1200 Main Street is where we meet. '
            ELSE '' END || text AS text,
       CASE doc_id % 4 WHEN 0 THEN 'instagram' WHEN 1 THEN 'facebook' WHEN 2 THEN 'youtube' ELSE 'search' END AS kind
FROM documents""",
    "site_pages": """
SELECT page_id, url,
       CASE page_id % 6 WHEN 0 THEN '<a href="/about-us">Who we are</a><a href="mailto:info@x' || CAST(page_id AS STRING) || '.org?subject=hi">Mail</a>'
            WHEN 1 THEN '<a href="/p1"><b>Our Staff</b></a><a href="tel:+1-330-555-0100">Call</a>' WHEN 2 THEN '<a href="/plan-a-visit">Visit</a>'
            WHEN 3 THEN '<a href="/x">Missions &amp; outreach</a><a href="javascript:void(0)">menu</a>' WHEN 4 THEN '<a href="/y">Locations</a>' ELSE '' END || html AS html
FROM pages""",
    "results": """
SELECT page_id % 40 AS query_id, CAST(page_id % 4 AS INT) AS provider_rank, page_id AS pos,
       CASE WHEN page_id % 17 = 0 THEN 'ftp://skip.example.org/' ELSE 'https://h' || CAST((page_id * 7) % 23 AS STRING) || '.example.org/' || CAST(page_id % 3 AS STRING) END AS url
FROM pages""",
    "proposals": """
SELECT o_custkey AS entity_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'email_verified' WHEN '2-HIGH' THEN 'denomination' WHEN '3-MEDIUM' THEN 'phone_verified' WHEN '5-LOW' THEN 'lead_pastor' ELSE 'staff_count' END AS field_name,
       CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE 'p' || CAST(o_orderkey % 11 AS STRING) END AS value,
       CASE WHEN o_orderkey % 3 = 0 THEN 'held' WHEN o_orderkey % 3 = 1 THEN '' ELSE NULL END AS current_value,
       CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(50 + o_orderkey % 51 AS DOUBLE) END AS confidence,
       CASE o_orderkey % 3 WHEN 0 THEN 'live_official_site' WHEN 1 THEN 'user_provided_ground_truth' ELSE 'staff_profile' END AS access_level,
       o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') AS is_contact, o_orderkey AS seq
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "cells": """
SELECT doc_id AS entity_id, s AS source, k AS key,
       CASE k WHEN 'staff_count' THEN CAST((doc_id % 50 + 1) * (CASE s WHEN 'tool' THEN 10 WHEN 'truth' THEN 10 + 4 * quality ELSE 13 END) AS STRING)
              WHEN 'avg_weekly_attendance' THEN CASE s WHEN 'truth' THEN '1.5k' WHEN 'tool' THEN CAST(1200 + 400 * toxic AS STRING) ELSE '2,100' END
              WHEN 'multi_site' THEN CASE s WHEN 'truth' THEN CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END ELSE CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END END
              WHEN 'lifecycle_stage' THEN CASE WHEN s = 'truth' AND quality = 0 THEN '' ELSE 'Growing' END
              WHEN 'city' THEN CASE s WHEN 'truth' THEN 'New Haven' WHEN 'tool' THEN CASE WHEN toxic = 1 THEN NULL ELSE 'new-haven area' END ELSE 'Haven' END
              ELSE CASE s WHEN 'tool' THEN 'A' ELSE 'B' END END AS value,
       CAST(CASE s WHEN 'tool' THEN 40 + doc_id % 60 WHEN 'baseline' THEN 60 + doc_id % 40 ELSE 100 END AS DOUBLE) AS confidence
FROM labels, (SELECT 'tool' AS s UNION ALL SELECT 'baseline' UNION ALL SELECT 'truth') sources,
     (SELECT 'staff_count' AS k UNION ALL SELECT 'avg_weekly_attendance' UNION ALL SELECT 'multi_site' UNION ALL SELECT 'lifecycle_stage' UNION ALL SELECT 'city' UNION ALL SELECT 'denomination') keys""",
    "roster": """
SELECT c_custkey AS row_idx, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE CAST(c_custkey - c_custkey % 4 AS STRING) END AS sno,
       CASE WHEN c_custkey % 21 = 0 THEN '26:16:00' WHEN c_custkey % 25 = 0 THEN '42' WHEN c_custkey % 31 = 0 THEN ' ' ELSE ' ' || c_name || ' ' END AS org_name,
       CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey AS STRING) || ' Main St' END AS street,
       CASE WHEN c_custkey % 5 = 0 THEN 'Suite 2' ELSE '' END AS suite, c_mktsegment AS district,
       CASE WHEN c_custkey % 2 = 0 THEN ', Spanish' ELSE 'English' END AS lang
FROM customer""",
    "robots": """
SELECT 'https://r' || CAST(n_nationkey AS STRING) || '.example.org' AS origin, i AS line_no,
       CASE i WHEN 1 THEN 'User-agent: *' WHEN 2 THEN 'Disallow: /private # hidden' WHEN 3 THEN 'Allow: /private/open' WHEN 4 THEN 'User-agent: otherbot' WHEN 5 THEN 'Disallow: /'
              WHEN 6 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'User-agent: factloom' ELSE 'User-agent: more' END ELSE 'Disallow: /*.pdf$' END AS line
FROM nation, (SELECT 1 AS i UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) lines""",
    "robot_urls": """
SELECT 'https://r' || CAST(s_nationkey AS STRING) || '.example.org' AS origin,
       'https://r' || CAST(s_nationkey AS STRING) || '.example.org' || CASE s_suppkey % 6 WHEN 0 THEN '/private/x' WHEN 1 THEN '/private/open/a' WHEN 2 THEN '/a.pdf' WHEN 3 THEN '/a.pdf.html' WHEN 4 THEN '' ELSE '/public' END || '?q=' || CAST(s_suppkey AS STRING) AS url
FROM supplier""",
    "candidates": """
SELECT p_partkey % 97 AS entity_id, p_partkey AS seq, 'https://s' || CAST(p_partkey % 31 AS STRING) || '.example.org/' AS url,
       CASE p_partkey % 7 WHEN 0 THEN 'official' WHEN 1 THEN 'official' WHEN 2 THEN 'denom_directory' WHEN 3 THEN 'general_directory' WHEN 4 THEN 'social_profile' WHEN 5 THEN 'vendor_reference' ELSE 'unknown' END AS kind,
       CASE p_partkey % 3 WHEN 0 THEN 'original' WHEN 1 THEN 'search' ELSE 'domain_guess' END AS source,
       p_size % 11 <> 0 AS reachable, p_size % 13 = 0 AS parked, p_partkey % 41 <> 0 AS usable_name,
       p_size % 2 = 0 AS name_full, p_size % 4 = 0 AS name_strong, CAST(p_size % 5 AS DOUBLE) / 4 AS name_ratio,
       CASE p_size % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'conflict' ELSE 'unknown' END AS place, p_size > 20 AS content, p_size % 4 AS ownership
FROM part""",
    "profile": """
SELECT c_custkey AS entity_id, c_custkey AS seq,
       CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey * 37 % 6000 AS DOUBLE) END AS attendance,
       CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey * 37 % 6000 * 3 AS DOUBLE) ELSE NULL END AS online,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey % 4 AS DOUBLE) ELSE NULL END AS campuses,
       CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(c_custkey * 13 % 101 AS DOUBLE) END AS digital,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey * 29 % 101 AS DOUBLE) END AS growth,
       CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE CAST(c_custkey * 31 % 101 AS DOUBLE) END AS change,
       CAST(c_custkey * 17 % 101 AS DOUBLE) AS planting, CAST(c_custkey * 19 % 140 - 20 AS DOUBLE) AS leadership, CAST(c_custkey % 70 AS DOUBLE) AS staff, CAST(c_custkey % 6 AS DOUBLE) AS services,
       CASE c_custkey % 7 WHEN 0 THEN 'plant' WHEN 1 THEN 'growing' WHEN 2 THEN 'established' WHEN 3 THEN 'plateaued' WHEN 4 THEN 'declining' WHEN 5 THEN 'relaunch_revitalization' ELSE '' END AS stage,
       CASE c_custkey % 4 WHEN 0 THEN 'live_official_site' WHEN 1 THEN 'search_snippets' WHEN 2 THEN 'vendor_reference' ELSE 'staff_profile' END AS access_level,
       CASE c_custkey % 6 WHEN 0 THEN 'Southern Baptist' WHEN 1 THEN 'Unknown' WHEN 2 THEN 'Independent' WHEN 3 THEN NULL ELSE 'Old Order' END AS denomination,
       CASE WHEN c_custkey % 12 = 3 THEN NULL WHEN c_custkey % 12 = 4 THEN 'Acts 29' ELSE ' ' END AS network
FROM customer""",
    "builds": """
SELECT c_custkey AS entity_id, CASE c_custkey % 3 WHEN 0 THEN 'true_match' WHEN 1 THEN 'uncertain' ELSE 'no_match' END AS identity_verdict,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE 'https://org' || CAST(c_custkey AS STRING) || '.example.org' END AS identity_site,
       CAST(40 + c_custkey % 61 AS DOUBLE) AS identity_confidence, CASE WHEN c_custkey % 2 = 0 THEN 'search' ELSE 'original' END AS method,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'https://org' || CAST(c_custkey AS STRING) || '.example.org' END AS official_site, c_custkey % 4 = 0 AS official_crawled,
       CAST(c_custkey % 101 AS DOUBLE) AS research_confidence,
       CASE c_custkey % 4 WHEN 0 THEN 'live_official_site' WHEN 1 THEN 'search_snippets' WHEN 2 THEN 'vendor_reference' ELSE 'staff_profile' END AS access_level,
       CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Network ' || CAST(c_custkey % 6 AS STRING) END AS denomination,
       CASE WHEN c_custkey % 3 = 1 THEN 'Ann Lee' END AS lead_pastor,
       CASE WHEN c_custkey % 2 = 0 THEN 'Bob Ray' END AS f_pastor, CASE WHEN c_custkey % 5 <> 0 THEN 'office@org.example.org' END AS f_email, CASE WHEN c_custkey % 8 <> 0 THEN '(330) 555-0100' END AS f_phone,
       CASE WHEN c_custkey % 9 = 0 THEN CAST(c_custkey % 40 AS STRING) END AS f_staff, CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 4 + 1 AS STRING) END AS f_campus,
       CAST(50 + c_custkey % 45 AS DOUBLE) AS f_confidence, CASE WHEN c_custkey % 3 = 0 THEN 'https://a.example.org/staff' WHEN c_custkey % 3 = 1 THEN '' END AS f_url,
       CASE WHEN c_custkey % 4 <> 1 THEN CAST(60 + c_custkey % 38 AS DOUBLE) END AS e_pastor, CASE WHEN c_custkey % 4 = 2 THEN CAST(70 + c_custkey % 30 AS DOUBLE) END AS e_email,
       CASE WHEN c_custkey % 2 = 1 THEN CAST(55 + c_custkey % 40 AS DOUBLE) END AS e_denomination,
       CASE WHEN c_custkey % 8 = 3 THEN NULL ELSE c_custkey * 37 % 6000 END AS attendance, CASE WHEN c_custkey % 13 = 3 THEN NULL ELSE c_custkey * 37 % 6000 - 5 END AS attendance_min, c_custkey * 37 % 6000 + 5 AS attendance_max,
       CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE CAST(c_custkey % 101 AS DOUBLE) END AS attendance_confidence
FROM customer""",
    "run_starts": """
SELECT event_id AS run_id, user_id AS entity_id, event_type AS run_type, event_id AS started_at FROM events""",
    "run_ends": """
SELECT event_id AS run_id, CASE WHEN value < 5 THEN 'no answer' END AS error_message, event_id % 1000 AS tokens_in, event_id % 300 AS tokens_out, event_id + 1 AS completed_at FROM events WHERE event_id % 7 <> 0
UNION ALL SELECT event_id, CASE WHEN value < 50 THEN 'late answer' END, event_id % 500, 10, event_id + 2 FROM events WHERE event_id % 5 = 0""",
    "answers": """
SELECT k AS answer_id, conv_id AS entity_id, turn AS seq, CASE turn % 5 WHEN 0 THEN 'verification' WHEN 1 THEN 'contact' WHEN 2 THEN 'denomination' WHEN 3 THEN 'size' ELSE 'multiplication' END AS schema_name,
       CASE WHEN k % 31 = 0 THEN 'no json here' WHEN k % 37 = 0 THEN '[1, 2]' ELSE '{' || CASE turn % 5
            WHEN 0 THEN '"active_status": "' || CASE k % 6 WHEN 0 THEN 'Verified Active' WHEN 1 THEN 'Likely Active' WHEN 2 THEN 'Uncertain' WHEN 3 THEN 'Closed' WHEN 4 THEN 'Merged' ELSE CASE WHEN k % 12 = 5 THEN 'Gone' ELSE 'Merged' END END
                 || '", "website_verified": ' || CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN '""' WHEN 2 THEN '"https://org' || n || '.example.org/about"' ELSE '"https://new' || n || '.example.org"' END || ', "website_verified_confidence": ' || CAST(k * 11 % 101 AS STRING)
                 || ', "active_status_confidence": ' || CASE WHEN k % 23 = 0 THEN '"high"' ELSE CAST(50 + k * 3 % 53 AS STRING) || '.25' END || ', "closure_merger_signals": ' || CASE WHEN k % 29 = 0 THEN '["a", 7]' WHEN k % 4 = 1 THEN '["sale", "moved"]' WHEN k % 4 = 2 THEN '["gone"]' ELSE '[]' END
                 || ', "reasoning": "' || t || '"'
            WHEN 1 THEN '"email_verified": ' || CASE k % 4 WHEN 0 THEN 'null' ELSE '"office@org' || n || '.example.org"' END || CASE WHEN k % 9 = 0 THEN '' ELSE ', "email_confidence": ' || CAST(k * 7 % 120 AS STRING) END || ', "phone_verified": ' || CASE k % 7 WHEN 0 THEN '3305550100' ELSE '"(330) 555-0100"' END
                 || ', "phone_confidence": ' || CASE k % 8 WHEN 0 THEN 'null' ELSE CAST(k * 5 % 101 AS STRING) END || ', "lead_pastor": "Ann Lee", "lead_pastor_confidence": ' || CASE k % 6 WHEN 0 THEN '-0.5' ELSE '81' END
            WHEN 2 THEN '"denomination": ' || CASE k % 5 WHEN 0 THEN 'null' ELSE '"Unknown"' END || ', "denomination_confidence": ' || CAST(k * 3 % 110 AS STRING) || CASE WHEN k % 4 = 0 THEN '' ELSE ', "network_affiliation": "Acts 29"' END || ', "network_confidence": ' || CASE k % 7 WHEN 0 THEN 'true' ELSE '40' END
            WHEN 3 THEN '"attendance_estimate": ' || CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"about 300"' ELSE CAST(k % 900 AS STRING) END || ', "attendance_min": 100, "attendance_max": null, "attendance_confidence": ' || CAST(k * 13 % 105 AS STRING)
                 || ', "attendance_confidence_tier": ' || CASE k % 6 WHEN 0 THEN '"Huge"' WHEN 1 THEN '3' ELSE '"Very Low"' END || ', "staff_count": ' || CASE k % 5 WHEN 0 THEN '[4]' ELSE '4' END || ', "campus_count": 1' || CASE WHEN k % 3 = 0 THEN '' ELSE ', "weekend_services_count": 2' END || ', "reasoning": "' || t || '"'
            ELSE '"church_planting_activity": ' || CAST(k * 3 % 103 AS STRING) || ', "disciple_making": 10, "leadership_development": ' || CAST(k * 7 % 101 AS STRING) || ', "residency_internship": 0, "mission_sending": ' || CASE k % 11 WHEN 0 THEN '"many"' ELSE '55.5' END
                 || ', "kingdom_collaboration": ' || CAST(k * 5 % 101 AS STRING) || ', "innovation": ' || CAST(k * 17 % 101 AS STRING) || ', "multiplication_orientation": ' || CAST(k * 19 % 101 AS STRING) || CASE WHEN k % 13 = 0 THEN '' ELSE ', "digital_reach": ' || CAST(k % 101 AS STRING) END || ', "explanation": "' || t || '"'
            END || ', "evidence": ' || CASE k % 10 WHEN 0 THEN '[]' WHEN 7 THEN CASE WHEN k % 3 = 0 THEN '{}' ELSE '[]' END ELSE '[{"field_name": "active_status", "proposed_value": ' || CASE k % 3 WHEN 0 THEN 'null' ELSE '"v' || n || '"' END || ', "evidence_text": "' || t || '", "source_url": '
                 || CASE k % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"https://www.facebook.com/p/' || n || '"' WHEN 2 THEN '"https://www.org' || n || '.example.org/a"' ELSE '"not a url"' END || ', "confidence_score": ' || CAST(k * 13 % 102 AS STRING) || '}'
                 || CASE WHEN k % 5 = 0 THEN ', {"field_name": 5, "evidence_text": "x", "source_url": "https://duckduckgo.com/?q=x", "confidence_score": 12}' WHEN k % 5 = 1 THEN ', {"field_name": "website_verified", "proposed_value": "w", "evidence_text": "y", "source_url": "https://yelp.com/b", "confidence_score": 33.335}' WHEN k % 25 = 2 THEN ', 3' ELSE '' END || ']' END || '}' END AS raw
FROM (SELECT conv_id, turn, conv_id * 8 + turn AS k, CAST(conv_id AS STRING) AS n, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(9), ' ') AS t FROM conversations) turns""",
    "bundles": """
SELECT CAST(floor(page_id / 5) AS BIGINT) AS entity_id, max(CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 3 <> 0 THEN url END) AS official_site, CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 5 <> 0 THEN 'fetch' END AS crawl_method,
       CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 7 = 0 THEN 'The server refused.' END AS note, count(CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 4 <> 0 AND page_id % 3 <> 0 THEN 1 END) AS n_ok_pages,
       count(CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 8 <> 0 THEN 1 END) AS n_results
FROM pages GROUP BY CAST(floor(page_id / 5) AS BIGINT), CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 5 <> 0 THEN 'fetch' END, CASE WHEN CAST(floor(page_id / 5) AS BIGINT) % 7 = 0 THEN 'The server refused.' END""",
    "outputs": """
SELECT conv_id * 1000 + turn AS output_id,
       CASE turn % 5 WHEN 0 THEN 'Here it is: ```json' || chr(10) || '{"lifecycle_stage": "' || CASE conv_id % 3 WHEN 0 THEN 'thriving' WHEN 1 THEN 'Plateau' ELSE 'odd' END || '", "staff_count": "' || CAST(conv_id AS STRING) || ' people", "fields": [{"field": "city", "value": "X", "confidence": "high"}]}' || chr(10) || '```'
            WHEN 1 THEN '{"growth_orientation_score": "low", "digital_maturity_score": ' || CAST(conv_id % 100 AS STRING) || ', "lead_pastor": "'
            WHEN 2 THEN 'text {"a": [1, 2, {"b": "c' WHEN 3 THEN 'no json here' ELSE '{"change_readiness_score": null, "fields": [{"field_name": "", "value": null}, {"name": "email", "value": "e@x.org", "confidence": 55}], "church_app_status": "active"} and {"more": 1}' END AS raw
FROM conversations""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A logical table over the tables in ``sf_dir``."""
    for t in TABLES[name]:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """A query over logical tables, for an engine that has the driver's tables."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + sql
