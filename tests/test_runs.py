"""Schemas, runs, result pages, contexts and batches on small tables."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import batches, context, result_pages, runs, schemas

ITEM = '{"field_name": "f", "proposed_value": null, "evidence_text": "t", "source_url": "u", "confidence_score": 5}'


def test_every_violated_path_is_a_row(spark):
    rows = [
        (1, "denomination", '{"denomination":"A","denomination_confidence":50,"network_affiliation":"x","network_confidence":101.5,"evidence":[' + ITEM.replace(": 5", ": -1") + ',3,{"field_name":4,"evidence_text":"t","source_url":"u","confidence_score":1e1}]}'),
        (2, "denomination", "[1]"), (3, "denomination", "nope"), (4, "denomination", None), (5, "odd", "{}"),
        (6, "denomination", '{"denomination":"A","denomination_confidence":0,"network_affiliation":"x","network_confidence":100,"evidence":[' + ITEM + '],"more":[1]}'),
        (7, "verification", '{"active_status":"Gone","website_verified":null,"website_verified_confidence":"9","active_status_confidence":true,"closure_merger_signals":["a",1],"reasoning":"r","evidence":{}}'),
    ]
    df = spark.createDataFrame(rows, "id long, schema_name string, json string")
    got = sorted(map(tuple, schemas.violations(df, ["id"]).collect()))
    assert got == [
        (1, 0, "network_confidence", "too_big", "at most 100", "101.5"), (1, 1, "evidence[0].confidence_score", "too_small", "at least 0", "-1"), (1, 2, "evidence[1]", "invalid_type", "object", "number"),
        (1, 3, "evidence[2].field_name", "invalid_type", "string", "number"), (1, 4, "evidence[2].proposed_value", "invalid_type", "string", "undefined"),
        (2, 0, "", "invalid_type", "object", "array"), (3, 0, "", "invalid_type", "object", "no JSON"), (4, 0, "", "invalid_type", "object", "no JSON"),
        (7, 0, "active_status", "invalid_enum_value", "Verified Active|Likely Active|Uncertain|Closed|Merged", "Gone"), (7, 1, "website_verified_confidence", "invalid_type", "number", "string"),
        (7, 2, "active_status_confidence", "invalid_type", "number", "boolean"), (7, 3, "closure_merger_signals[1]", "invalid_type", "string", "number"), (7, 4, "evidence", "invalid_type", "array", "object"),
    ]
    valid = schemas.typed(df, "denomination", ["id"]).collect()
    assert [r.id for r in valid] == [6] and valid[0].a.network_confidence == 100 and valid[0].a.evidence[0].source_url == "u"
    assert schemas.violations(df.limit(0), ["id"]).collect() == []


def test_a_failed_run_leaves_the_others(spark):
    requested = spark.createDataFrame([(i, k) for i in range(4) for k in ("verify", "score")], "entity_id long, run_type string")
    bundles = spark.createDataFrame([(0, None, None, None, 0, 0), (1, "https://a.org", "fetch", "Slow.", 0, 2), (2, "https://b.org", "fetch", None, 3, 2)], "entity_id long, official_site string, crawl_method string, note string, n_ok_pages long, n_results long")
    answers = spark.createDataFrame([(1, "verify", None, None, 7), (2, "verify", "too_big", "x", 8), (2, "score", "invalid_type", "", 9), (0, "score", None, None, 5)], "entity_id long, run_type string, problem string, path string, tokens long")
    got = {(r.entity_id, r.run_type): (r.status, r.error_message, r.called, r.tokens) for r in runs.run_entities(requested, bundles, answers).collect()}
    assert got == {
        (0, "verify"): ("completed", None, False, 0), (0, "score"): ("completed", None, True, 5), (1, "verify"): ("completed", None, True, 7), (1, "score"): ("failed", "no answer", True, 0),
        (2, "verify"): ("failed", "too_big at x", True, 8), (2, "score"): ("failed", "invalid_type at the root", True, 9), (3, "verify"): ("failed", "entity 3 not found", False, 0), (3, "score"): ("failed", "entity 3 not found", False, 0),
    }
    items = {r.entity_id: (r.evidence_summary, r.source_urls) for r in runs.research_items(bundles).collect()}
    assert items == {
        0: ("No official website could be identified [crawlMethod=none]. Web search returned no results (outbound search may be blocked).", []),
        1: ("Found a candidate site (https://a.org) but could not read any pages [crawlMethod=fetch]. Slow.", ["https://a.org"]),
    }


def test_pages_of_unknown_providers_and_odd_markup(spark):
    fallback = '<a class="title" href="https://t.org/1">One &lt;x&gt;</a><a class="title" href="https://t.org/2">\n Two </a>'
    rows = [(1, "mojeek", 200, fallback), (2, "unknown", 200, fallback), (3, "bing", None, None), (4, "bing", 200, "")]
    read = result_pages.read_pages(spark.createDataFrame([(*r, None) for r in rows], "page_id long, provider string, status int, body string, note string"))
    assert [(r.page_id, r.result_no, r.url, r.title) for r in result_pages.results(read).orderBy("page_id", "result_no").collect()] == [(1, 0, "https://t.org/1", "One <x>"), (1, 1, "https://t.org/2", "Two")]
    assert sorted((r.page_id, r.result_count, r.ok, r.status) for r in result_pages.diagnostics(read).collect()) == [(1, 2, True, 200), (2, 0, False, 200), (3, 0, False, 0), (4, 0, False, 200)]


@pytest.mark.parametrize("most", [1, 60, 137, 138, 500, 100_000])
def test_context_is_cut_at_its_budget(spark, most):
    rows = [(i % 3, i, "staff_page" if i % 2 else "search", "live_official_site", i % 4 == 0, 0.5, f"https://x.org/{i}", "t" if i % 5 else None, "word " * i, "snip " * i) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id long, seq long, source_type string, access_level string, fetched boolean, reliability double, url string, title string, text string, snippet string")
    df = df.withColumn("fields", F.from_json(F.lit("[]"), "array<struct<field_name: string, value: string>>"))
    lines = {}
    for r in df.select("entity_id", "seq", context.finding_line().alias("line")).orderBy("seq").collect():
        lines.setdefault(r.entity_id, []).append(r.line)
    got = {r.entity_id: r.context for r in context.findings_context(df, most).collect()}
    assert got == {k: "\n".join(v)[:most] for k, v in lines.items()}


def test_batches_may_be_written_again(spark, tmp_path):
    path, schema = str(tmp_path / "rows"), "entity_id long, value string"
    df = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    read = lambda: sorted(map(tuple, batches.read_batches(spark, path, schema).collect()))
    assert read() == []
    for _ in range(2):
        batches.write_batch(df, path, 0)
        batches.write_batch(df.where("entity_id = 2").withColumn("value", F.lit("c")), path, 1)
        assert read() == [(1, "a", 0), (2, "b", 0), (2, "c", 1)]
    assert sorted((r.entity_id, r.value) for r in batches.latest(batches.read_batches(spark, path, schema), ["entity_id"]).collect()) == [(1, "a"), (2, "c")]


def test_only_what_is_missing_is_computed(spark, tmp_path):
    path, schema, asked = str(tmp_path / "cache"), "entity_id long, value string", []
    entries = spark.range(5).withColumnRenamed("id", "entity_id")

    def compute(rows):
        asked.append(sorted(r[0] for r in rows.select("entity_id").collect()))
        return rows.select("entity_id", F.lit("x").alias("value"))

    assert [batches.run_missing(e, path, schema, k, compute) for k, e in enumerate((entries.where("entity_id < 3"), entries, entries))] == [3, 2, 0]
    assert asked == [[0, 1, 2], [3, 4]]
    assert batches.run_missing(entries, path, schema, 1, compute) == 2 and batches.read_batches(spark, path, schema).count() == 5


def test_a_stream_that_is_read_again_leaves_the_same_rows(spark, tmp_path):
    source, path, schema = str(tmp_path / "in"), str(tmp_path / "out"), "entity_id long, value string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.parquet(source)
    for attempt in range(2):
        stream = spark.readStream.schema(schema).parquet(source)
        batches.stream_batches(stream, path, str(tmp_path / f"log{attempt}"), lambda k: F.lit(k + 10)).awaitTermination(60)
    got = batches.read_batches(spark, path, schema + ", checked_at int").collect()
    assert sorted((r.entity_id, r.value, r.checked_at, r.batch_id) for r in got) == [(1, "a", 10, 0), (2, "b", 10, 0)]


def test_pages_are_parsed_once_for_their_links(spark):
    from factloom.plans import registry

    plan = registry.queries()["link_diagnostics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "href=" not in plan
