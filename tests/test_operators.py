"""Operators on small tables: ties, first wins, merges, queues, staff, streams."""

from pyspark.sql import functions as F

from factloom.functions import confidence as C
from factloom.operators import coverage, facts, ingest, merge, query, report, search, staff
from factloom.streaming import evidence_log


def test_best_fact_keeps_the_first_of_equal_ones(spark):
    rows = [(1, "f", "late", 60.0, 0.5, 2), (1, "f", "early", 60.0, 0.5, 1), (1, "f", "", 99.0, 1.0, 0), (1, "f", None, 99.0, 1.0, 0), (2, "f", "x", 10.0, 0.1, 9)]
    df = spark.createDataFrame(rows, "entity_id int, field_name string, value string, confidence double, reliability double, seq int")
    assert sorted((r.entity_id, r.value) for r in facts.best_facts(df).collect()) == [(1, "early"), (2, "x")]


def test_conflicts_keep_both_values(spark):
    rows = [(1, "phone", "(330) 555-0100", 0.5, "search_snippets", 1), (1, "phone", "330.555.0100", 0.9, "staff_profile", 2), (1, "phone", "330-555-0199", 0.5, "search_snippets", 3), (2, "phone", "1", 0.5, "search_snippets", 1), (2, "phone", " 1", 0.5, "search_snippets", 2)]
    df = spark.createDataFrame(rows, "entity_id int, key string, value string, reliability double, access_level string, seq int")
    (got,) = facts.conflicts(df.withColumn("norm", facts.norm_for_conflict(F.col("key"), F.col("value")))).collect()
    assert (got.entity_id, got.value_a, got.value_b, got.confidence) == (1, "330.555.0100", "330-555-0199", 60)


def test_structured_candidates(spark):
    df = spark.createDataFrame([("email", "a@b"), ("staff_count", "many"), ("staff_count", "7"), ("other", "x"), ("phone", "")], "field_name string, value string")
    assert sorted(tuple(r) for r in facts.structured_candidates(df).collect()) == [("office_email", "a@b"), ("staff_count", "7")]


def test_merge_never_overwrites_without_review(spark):
    rows = [(1, "a", "v", None, 95.0, "live_official_site", False), (2, "a", "v", "held", 95.0, "live_official_site", False), (3, "a", "v", None, 88.0, "live_official_site", True), (4, "a", "v", None, 99.0, "search_snippets", False), (5, "a", "", None, 99.0, "live_official_site", False), (6, "a", "v", "held", 70.0, "live_official_site", False), (7, "a", "v", "", 50.0, "staff_profile", False)]
    df = spark.createDataFrame(rows, "entity_id int, field_name string, value string, current_value string, confidence double, access_level string, is_contact boolean")
    before = spark.createDataFrame([(6, "a", 80.0)], "entity_id int, field_name string, confidence double")
    got = {r.entity_id: r.decision for r in merge.merge_decisions(df, before).collect()}
    assert got == {1: "update", 2: "review", 3: "review", 4: "review", 6: "skipped", 7: "evidence_only"}


def test_queue_has_one_pending_item_per_field(spark):
    schema = "id int, entity_id int, field_name string, proposed_value string, confidence double, review_status string, created_at int, seq int"
    queue = spark.createDataFrame([(1, 1, "f", "old", 60.0, "pending", 5, 0), (2, 1, "f", "done", 60.0, "approved", 6, 0)], schema)
    new = spark.createDataFrame([(3, 1, "f", "new", 70.0, "pending", 9, 1), (4, 1, "f", "newer", None, "pending", 9, 2), (5, 1, "g", "g", 61.0, "pending", 9, 3)], schema)
    got = {r.id: (r.proposed_value, r.confidence, r.created_at) for r in merge.enqueue_reviews(queue, new).collect()}
    assert got == {1: ("newer", 60.0, 5), 2: ("done", 60.0, 6), 5: ("g", 61.0, 9)}


def test_lowest_approved_review_is_applied_last(spark):
    rows = [(1, "staff_count", "300 [150-500]", 60.0, "approved", 1), (1, "staff_count", "9", 80.0, "approved", 2), (1, "city", "x", None, "approved", 3), (1, "city", "y", 60.0, "approved", 4), (2, "city", "z", 1.0, "pending", 5)]
    df = spark.createDataFrame(rows, "entity_id int, field_name string, proposed_value string, confidence double, review_status string, seq int")
    assert sorted((r.field_name, r.applied_value) for r in merge.apply_reviews(df).collect()) == [("city", "x"), ("staff_count", None)]


def test_import(spark):
    header = ["S.No", "Organization Name", "Address 1", "City", "Languages", "Parent Organization"]
    at = ingest.detect_columns(header)
    assert at["rowid"] == 0 and at["name"] == 1 and at["language"] == 4 and at["parent"] == 5
    rows = [(0, ["7", "Oak", "1 Main", "Lima", ", Spanish", "North"]), (1, ["7", "Again", "", "", "", ""]), (2, ["", "26:16:00", None, "x", "", ""]), (3, ["9", " ", "", "Lima", "", ""])]
    recs = ingest.map_roster(spark.createDataFrame(rows, "row_idx int, cells array<string>"), at)
    got = {r.row_idx: r for r in recs.collect()}
    assert sorted(got) == [0, 1, 2]
    assert got[0].language == "Spanish" and got[0].country == "United States" and got[0].notes == "Seed parent org: North"
    assert got[2].original_row_id == "row-2" and got[2].suspect
    new = merge.insert_absent(spark.createDataFrame([("row-2",)], "original_row_id string"), recs, "original_row_id", [F.asc("row_idx")])
    assert [(r.original_row_id, r.name) for r in new.collect()] == [("row-7", "Oak")]
    assert merge.insert_absent(recs, recs, "original_row_id", [F.asc("row_idx")]).count() == 0


def test_entity_filters(spark):
    rows = [(1, "Oak", "OH", None, "", 5.0, None), (2, "Elm", "OH", "", "e", None, 1), (3, "oakland", "TX", "w", None, 9.0, None)]
    df = spark.createDataFrame(rows, "id int, name string, state string, website string, email string, fit_score double, last_checked_at int").withColumn("lead_name", F.lit(None).cast("string"))
    ids = lambda **f: [r.id for r in query.list_entities(df, query.EntityFilter(**f)).collect()]
    assert ids(limit=10) == [3, 1, 2]
    assert ids(search="OAK", limit=1, offset=1) == [1]
    assert sorted(ids(missing_website=True)) == [1, 2] and sorted(ids(missing_email=True)) == [1, 3]
    assert ids(min_fit=6) == [3] and sorted(ids(needs_verification=True)) == [1, 3]
    assert ids(search="%") == []
    f = query.EntityFilter.from_query({"state": "OH", "missing_website": "1"})
    assert (f.limit, f.offset, f.state, f.missing_website) == (100, 0, "OH", True)


def test_robots(spark):
    text = ["User-agent: *", "Disallow: /a", "Allow: /a/b", "Disallow: /*.pdf$", "User-agent: other", "Disallow: /"]
    lines = spark.createDataFrame([("o", i, t) for i, t in enumerate(text)], "origin string, line_no int, line string")
    urls = {"http://o/a": False, "http://o/a/b": True, "http://o/x.pdf": False, "http://o/x.pdf?y": False, "http://o/x.pdfs": True, "http://o": True}
    got = search.robots_allowed(spark.createDataFrame([("o", u) for u in urls], "origin string, url string"), search.robots_rules(lines, "bot")).collect()
    assert {r.url: r.allowed for r in got} == urls


def test_staff_cards(spark):
    text = "Home\nDr. Ann Lee\nLead Pastor\nBob Stone — Executive Pastor\nSue Ray\nNext Gen\nDr. Ann Lee\nCreative Director\nThe end.\nJim Fox\nHe has led for many years and loves every one of you."
    cards = staff.staff_cards(spark.createDataFrame([(1, text), (2, None)], "page_id int, inner_text string"), "page_id")
    assert [(r.role_field, r.role_confidence) for r in cards.orderBy("card_seq").collect()] == [("lead_pastor", 80), ("executive_pastor", 80), (None, None)]
    assert [(r.card_seq, r.name, r.title) for r in cards.orderBy("card_seq").collect()] == [(0, "Ann Lee", "Lead Pastor"), (1, "Bob Stone", "Executive Pastor"), (2, "Sue Ray", "Next Gen")]
    (s,) = staff.staff_summary(cards, "page_id").collect()
    assert (s.n_cards, s.n_roles) == (3, 2)


def test_staff_cards_of_a_rendered_page(spark):
    people = [("Jacob Young", "Lead Pastor"), ("Rachel Carpenter", "Operations"), ("Matthew Ellis", "Weekends"), ("Bruce Oberlin", "Community Ambassador"), ("Debbie Ring", "Next Steps")]
    page = "Home\nAbout\nOur Staff\nGive\n\nMeet Our Team\n\n" + "\r\n\n".join(f"{n}\n{t}" for n, t in people) + "\nPastor Brenda Young\nTeaching Pastor\n\nContact Us\n"
    lines = "Ann Lee\nBob Stone — Youth Pastor\nBob Stone\nKids\nann lee, Creative Director\nAnn Lee | Creative Director\nJim Fox\nSue Ray\nElder"
    many = "\n".join(f"Ann{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} Lee\nKids Director" for i in range(3000)) + "\nAnnaaa Lee\nElder"
    rows = spark.createDataFrame([(1, page), (2, lines), (3, ""), (4, None), (5, many)], "id int, t string").select("id", staff.cards_column(F.col("t")).alias("c")).collect()
    got = {r.id: [(x.name, x.title) for x in r.c] for r in rows}
    assert got[1] == [*people, ("Brenda Young", "Teaching Pastor")]
    # a title's line starts no card, the next line may; the first card of a name counts
    assert got[2] == [("Ann Lee", "Bob Stone — Youth Pastor"), ("Bob Stone", "Kids"), ("Sue Ray", "Elder")]
    assert got[3] == got[4] == [] and len(got[5]) == 3000


def test_staff_cards_read_each_line_once(spark):
    rows = spark.createDataFrame([(1, "Ann Lee"), (2, "Elder\nAnn Lee"), (3, "Ann Lee\nElder\nKids"), (4, "Cy Fox - Elder\nAnn Lee\nCy Fox - Kids\nAnn Lee - Elder")], "id int, t string").select("id", staff.cards_column(F.col("t")).alias("c"))
    got = {r.id: [(x.name, x.title) for x in r.c] for r in rows.collect()}
    assert got == {1: [], 2: [], 3: [("Ann Lee", "Elder")], 4: [("Cy Fox", "Elder"), ("Ann Lee", "Cy Fox - Kids")]}
    # expressions with lambdas are worked out as often as the plan names them
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count(staff.ONE_LINE) <= 3


def test_roster_numbers_are_dense_and_headers_are_kept(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("S.No,Organization Name,Notes,Notes\n" + "".join(f"{'' if i % 3 else i},Org {i},a,b\n" for i in range(1, 2001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    rows, header = ingest.read_roster(spark, str(path))
    try:
        assert rows.rdd.getNumPartitions() > 3
        got = rows.orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert header == ["S.No", "Organization Name", "Notes", "Notes"]
    assert [r.row_idx for r in got] == list(range(1, 2001)) and got[6].cells[1] == "Org 7"
    few, _ = ingest.read_roster(spark, str(path), limit=5)
    records = ingest.map_roster(few, ingest.detect_columns(header))
    assert [r.original_row_id for r in records.orderBy("row_idx").collect()] == ["row-1", "row-2", "row-3", "row-4", "row-5"]
    (tmp_path / "empty.csv").write_text("")
    assert ingest.read_roster(spark, str(tmp_path / "empty.csv"))[1] == []


def test_import_summary_counts_empty_rows(spark):
    raw = spark.createDataFrame([(1, ["1", "Oak", "x"]), (2, ["2", "", None]), (3, ["1", "26:16:00", ""]), (4, ["4", None, "z"])], "row_idx int, cells array<string>")
    every = ingest.map_roster(raw, {"rowid": 0, "name": 1, "address1": 2}, keep_empty=True)
    s = ingest.import_summary(every, every.limit(0)).first()
    # row 2 has no content: it warns and counts, but is neither imported nor skipped
    assert (s.imported, s.skipped, s.warnings, s.total) == (2, 1, 3, 4)


def test_conflicts_keep_the_best_of_each_norm(spark):
    rows = [(1, "phone", v, n, r, "staff_profile", s) for v, n, r, s in (("a", "1", 0.5, 1), ("b", "2", 0.9, 5), ("c", "2", 0.9, 4), ("d", "3", 0.7, 2), ("e", "1", 0.7, 3))] + [(2, "phone", "x", "1", 0.5, "staff_profile", 1)] * 3
    (r,) = facts.conflicts(spark.createDataFrame(rows, "entity_id int, key string, value string, norm string, reliability double, access_level string, seq int")).collect()
    assert (r.entity_id, r.value_a, r.value_b, r.confidence) == (1, "c", "d", 60)


def test_runs_open_close_and_fail(spark):
    starts = spark.createDataFrame([(1, 7, "verify", 10), (2, 7, "enrich", 11), (3, 8, "verify", 12)], "run_id int, entity_id int, run_type string, started_at int")
    ends = spark.createDataFrame([(1, None, 1000, 100, 20), (1, "late", 10, 10, 19), (2, "no answer", 2_000_000, 0, 30)], "run_id int, error_message string, tokens_in long, tokens_out long, completed_at int")
    got = {r.run_id: (r.status, r.tokens_used, r.cost_estimate, r.error_message) for r in report.close_runs(report.open_runs(starts, "m"), ends).collect()}
    assert got == {1: ("completed", 1100, 0.0045, None), 2: ("failed", 2_000_000, 6.0, "no answer"), 3: ("running", None, None, None)}


def test_meta_search_stops_at_enough_hosts(spark):
    rows = [(1, 0, i, f"https://h{i}.org/") for i in range(4)] + [(1, 1, 9, "https://h0.org/"), (1, 1, 10, "https://h9.org/")] + [(1, 2, 11, "https://late.org/"), (1, 0, 5, "ftp://x")]
    got = search.meta_search(spark.createDataFrame(rows, "query_id int, provider_rank int, pos int, url string")).collect()
    assert sorted(r.url for r in got) == [f"https://h{i}.org/" for i in (0, 1, 2, 3, 9)]


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "so The quick, brown fox jumps over it"), (2, "the quick brown foxes"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame([(1, "quick brown fox jumps over"), (2, "quick brown fox"), (3, ""), (4, "absent words")], "item_id int, text string")
    assert sorted(tuple(r) for r in search.phrase_hits(docs, items).collect()) == [(1, 1), (1, 2)]


def test_confidence_stays_below_its_cap(spark):
    df = spark.range(0, 200).select((F.col("id") - 20).cast("double").alias("c")).crossJoin(spark.createDataFrame([("live_official_site",), ("vendor_reference",)], "level string"))
    low, high = df.select(C.cap_confidence(F.col("c"), F.col("level")).alias("x"), C.cap_for_access(F.col("level")).alias("cap")).agg(F.min("x"), F.min(F.col("cap") - F.col("x"))).first()
    assert low == 0 and high == 0


def test_signals(spark):
    df = spark.createDataFrame([(1, 1, "t", "Give online, text 'GIVE' to", "https://a"), (1, 2, None, "Subsplash", "https://youtu.be/x"), (2, 1, None, None, "u")], "entity_id int, seq int, title string, body string, url string")
    got = {r.entity_id: r for r in coverage.signals_by_entity(df).collect()}
    assert got[1].online_giving and got[1].youtube and got[1].church_app and got[1].platforms == ["Subsplash"] and got[1].signals_detected == 4
    assert got[2].evidence_summary == "giving: none detected · platforms: none detected · media: none detected"


def test_signals_over_ends_and_of_many_findings(spark):
    import random
    import re

    from factloom.functions import extract as X

    rng = random.Random(3)
    words = ["text", "give", "to", "12345", "church", "center", "apple", "pay", "gifts", "of", "stock", "word", "planning", "more words of a long text here and on", "rock", "rms", " ", ""]
    rows = [(0 if i % 3 else i % 60, i, rng.choice([None, rng.choice(words)]), rng.choice(words), rng.choice([None, None, "https://a.org/text"])) for i in range(900)]
    for e, chain in enumerate([["text", "give", "to", "12345"], ["apple", " ", "pay now"], ["text to", "x", "12345"], ["apple a b c d e f g h", "pay"], ["text", "give of", "to 12345"], ["a b c d e f g h i church", "", "center b c d e f g h i j"]]):
        rows += [(1000 + e, k, None, t, None) for k, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "entity_id int, seq int, title string, body string, url string").repartition(5)
    hays = {}
    for e, _, *parts in sorted(rows, key=lambda r: r[:2]):
        hays.setdefault(e, []).append(" ".join([parts[0] or "", parts[1] or "", *([parts[2]] if parts[2] else [])]))
    got = coverage.signals_by_entity(df)
    for r in got.collect():
        low = " \n ".join(hays[r.entity_id]).lower()
        assert r.platforms == [n for n, p in X.PLATFORMS if re.search(p, low)], r
        assert {n: r[n] for n, _ in X.SIGNALS[:-1]} == {n: bool(re.search(p, low)) for n, p in X.SIGNALS[:-1]}, r
    assert got.count() == len(hays)
    # no list of an entity's texts is made
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_signals_are_matched_once_and_blanks_stay(spark):
    rows = [(1, 1, "t", "watch\nlive", "https://a"), (1, 2, None, "rock\trms", None), (2, 1, None, "apple", None), (2, 2, None, "pay", None), (None, 1, None, "google", None), (None, 2, None, "pay now", None)]
    got = coverage.signals_by_entity(spark.createDataFrame(rows, "entity_id int, seq int, title string, body string, url string"))
    by = {r.entity_id: r for r in got.collect()}
    assert not by[1].livestream and by[1].platforms == ["Rock RMS"] and by[2].apple_pay and by[None].google_pay
    # what starts from the signals doesn't match the texts again
    assert "podcast|" not in got._jdf.queryExecution().toString()


def test_words_of_signal_patterns_are_needed(spark):
    from factloom.functions import extract as X

    texts = """church center|churchcenter|planning  center|planningcenter|subsplash|thechurchapp|pushpay|tithe.ly|tithely|rock rms|rockrms|breezechms|breeze chms|a realm b|realm connect|onrealm|flocknote
online giving|give online|give now|ways to give|donate|x/give|x/giving|recurring gift|recurring giving|recurring donation|set up a recurring|set up recurring|auto giving|automatic giving|schedule a gift|schedule gift
apple pay|google pay|text-to-give|texttogive|give by text|text x to 12345|stock gift|stocks transfer|gifts of stock|appreciated securities|securities|crypto|cryptocurrency|bitcoin|ethereum|digital currency
donor-advised|donor advised fund|daf|livestream|live stream|watch live|streaming|live online|watch now|youtube.com|youtu.be|podcast|apple podcasts|spotify.com/show|anchor.fm
online campus|church online|watch online|virtual campus|download our app|download the app|mobile app|our app|app store|apps.apple.com|play.google.com/store/apps|apple|giving|center|plain words""".replace("\n", "|").split("|")
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    every = rows.select("t", X.signal_bits(F.col("t")).alias("bits"), *(F.col("t").rlike(p).alias(f"x{i}") for i, (_, p) in enumerate(X.PLATFORMS + X.SIGNALS))).collect()
    for r in every:
        assert r.bits == sum(r[f"x{i}"] << i for i in range(len(X.SIGNAL_NAMES))), r
    # what may be divided is divided as in the whole pattern, and each beginning of it is an open end
    for name, text in [("Church Center", "church center"), ("Planning Center", "planning center"), ("Rock RMS", "rock rms"), ("Breeze", "breeze chms"), ("apple_pay", "apple pay"), ("google_pay", "google pay"), ("text_to_give", "text x to 12345"), ("stock_giving", "stocks gift"), ("stock_giving", "gifts of stock"), ("stock_giving", "gift of stock")]:
        pieces = text.split(" ")
        ends = spark.createDataFrame([(" ".join(pieces[:k]) + " ",) for k in range(1, len(pieces))], "t string")
        assert all(r[0] for r in ends.select(F.col("t").rlike(X.OPEN_END)).collect()), text
        joined = spark.createDataFrame([(" \n ".join(pieces),)], "t string").select(X.divided_bits(F.col("t")), X.signal_bits(F.col("t"))).first()
        assert joined[0] == joined[1] == 1 << X.SIGNAL_NAMES.index(name)


def test_export_and_updates(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id int, name string, note string")
    assert report.export(df, str(tmp_path / "o.json")) == "json" and spark.read.json(str(tmp_path / "o.json")).count() == 2
    assert report.export(df, str(tmp_path / "o.xlsx")) == "csv"
    patch = spark.createDataFrame([(1, "n", "y")], "id int, note string, name string").select("id", "note")
    assert sorted(tuple(r) for r in merge.update_rows(df, patch).collect()) == [(1, "a", "n"), (2, "b", "x")]
    twice = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "k int, at int")
    assert sorted((r.k or 0, r.at) for r in merge.last_write(twice, ["k"], "at").collect()) == [(0, 3), (0, 4), (1, 2)]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.union(events).repartition(2).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    log = evidence_log.append_evidence(evidence_log.distinct_events(source), str(tmp_path / "log"), str(tmp_path / "cp"))
    log.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "log")).count() == events.count()
    q = evidence_log.windowed_counts(source).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("counts").select("window_start", "event_type", "n").collect()}
    want = {(r.window_start, r.event_type, 2 * r.n) for r in evidence_log.windowed_counts(events).collect()}
    assert got == want


def test_discovery_scenarios(spark):
    from factloom.operators import discover

    words = " sunday worship service times what to expect" * 12
    own = lambda name, more="": f"<title>{name}</title><a href='/g'>Give</a><a href='/s'>Sermons</a><p>{name}{words} {more}</p>"
    cases = {  # name, city, state, website, alternative, search results, pages by host
        1: ("Oak Hill Church", "Lima", "OH", "oakhill.org", None, [], {"oakhill.org": own("Oak Hill Church", "Lima")}),
        2: ("26:16:00", "Lima", "OH", None, None, ["https://some.org/"], {"some.org": own("Some Church")}),
        3: ("Elm Street Church", "Lima", "OH", None, None, ["https://bigbuilders.com/portfolio/elm"], {"bigbuilders.com": own("Elm Street Church portfolio")}),
        4: ("Pine Grove Church", "Lima", "OH", None, None, ["https://pines.org/"], {"pines.org": own("Pine Grove Church, TX")}),
        5: ("Grace Church", "Lima", "OH", None, None, ["https://gracehub.net/"], {"gracehub.net": own("Grace news") .replace("Give", "x").replace("Sermons", "y")}),
        6: ("Fair View Church", "Lima", "OH", None, None, ["https://www.yelp.com/biz/fv", "https://fairview.org/"], {"yelp.com": own("Fair View Church Lima"), "fairview.org": own("Fair View Church", "Lima")}),
        7: ("Low Valley Church", "Lima", "OH", None, None, ["https://www.manta.com/biz/lv"], {"manta.com": own("Low Valley Church Lima")}),
    }
    targets = spark.createDataFrame([(k, *v[:5]) for k, v in cases.items()], "entity_id int, name string, city string, state string, website string, alternative string")
    results = spark.createDataFrame([(k, i, u) for k, v in cases.items() for i, u in enumerate(v[5])], "entity_id int, rank int, url string")
    pages = [(h, 200, p) for v in cases.values() for h, p in v[6].items()]
    sites = discover.inspect(spark.createDataFrame(pages, "host string, status int, html string"))
    every = discover.candidates(targets, discover.seeds(targets, results), sites).cache()
    chosen = {k: (None, {}) for k in cases}
    for r in every.collect():
        chosen[r.entity_id][1][r.host] = r
    for r in discover.official_sites(targets, every).collect():
        chosen[r.entity_id] = (r.official_site, chosen[r.entity_id][1])
    assert chosen[1][0] == "https://oakhill.org/" and chosen[1][1]["oakhill.org"].identity >= 65
    assert chosen[2][0] is None and chosen[2][1]["some.org"].identity == 0
    assert chosen[3][0] is None and chosen[3][1]["bigbuilders.com"].kind == "vendor_reference"
    assert chosen[4][1]["pines.org"].place == "conflict" and chosen[4][0] is None
    assert not chosen[5][1]["gracehub.net"].name_strong and chosen[5][0] is None
    assert chosen[6][0] == "https://fairview.org/" and chosen[6][1]["yelp.com"].kind == "general_directory"
    assert chosen[7][0] is None and chosen[7][1]["manta.com"].identity <= 44


def test_contact_recovery(spark):
    from factloom.operators import collect

    page = "<title>C</title><p>Call (330) 555-0100</p><a href='mailto:office@x.org'>m</a><a href='tel:+13305550111'>t</a>"
    pages = spark.createDataFrame([(1, 1, "https://x.org/c", 200, "contact", page), (1, 2, "https://x.org/z", 404, "home", page)], "entity_id int, seq int, url string, status int, category string, html string")
    (f,) = collect.website_findings(pages).collect()
    assert [(x.field_name, x.value, x.confidence) for x in f.fields] == [("phone", "(330) 555-0100", 80), ("email", "office@x.org", 88), ("phone", "+13305550111", 85)]
    snippets = spark.createDataFrame([(1, 9, "https://facebook.com/x", "X", "info@y.org has 1.2k followers", None)], "entity_id int, seq int, url string, title string, snippet string, official_host string")
    every = collect.website_findings(pages).unionByName(collect.snippet_findings(snippets))
    best = {r.field_name: r.value for r in __import__("factloom.operators.facts", fromlist=["x"]).best_facts(collect.fact_candidates(every)).collect()}
    assert best["office_email"] == "office@x.org" and best["office_phone"] == "+13305550111"
    (d,) = collect.dossiers(every).collect()
    assert d.access_level == "live_official_site" and d.official_crawled and d.n_conflicts == 1 and d.source_types == 2


def test_staff_cards_and_repeated_urls(spark):
    from factloom.operators import collect

    page = "<title>Team</title><div><h3>Ann Lee</h3><p>Lead Pastor</p></div><div><h3>Bob Ray</h3><p>Director of Operations</p></div><p>Cy Fox - Kids Coordinator</p>"
    pages = spark.createDataFrame([(1, 1, "https://x.org/s", 200, "staff", page), (1, 2, "https://x.org/h", 200, "home", page)], "entity_id int, seq int, url string, status int, category string, html string")
    staff, home = sorted(collect.website_findings(pages).collect(), key=lambda r: r.seq)
    got = {(f.field_name, f.value, f.confidence) for f in staff.fields}
    assert got >= {("lead_pastor", "Ann Lee", 80.0), ("operations_leader", "Bob Ray", 78.0), ("staff_count", "3", 70.0)}
    assert "STAFF CARDS: Ann Lee — Lead Pastor • Bob Ray — Director of Operations" in staff.body and not home.fields
    results = spark.createDataFrame([(1, 9, "https://a.org", "B", "later", None), (1, 8, "https://a.org", "A", "first", None), (2, 7, "https://a.org", "C", "own", None)], "entity_id int, seq int, url string, title string, snippet string, official_host string")
    assert sorted((r.entity_id, r.body) for r in collect.snippet_findings(results).collect()) == [(1, "first"), (2, "own")]


def test_findings_read_whole_texts(spark, tmp_path):
    import re

    from factloom.plans import registry
    from factloom.sources.fixtures import view

    # a tail behind the 300th character for every second document
    tail = " ask the Senior Pastor at 408-555-78{:02d} or 12 Mill Road; 1,2{:02d} followers"
    docs = [(i, "plain words " * 40 + (tail.format(i, i) if i % 2 else ""), "en", "s", 1) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "https://a.org/", "<p>none</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    patterns = [r"(?i)[\d][\d,.]*\s*[KkMm]?\s+(followers|subscribers|likes)", r"(?i)\b(lead|senior|associate|executive|founding)\s+pastor\b", r"\(?\b\d{3}\)?[ .-]\d{3}[ .-]\d{4}\b", r"\b\d{2,6}\s+[A-Z][A-Za-z0-9 .]+\b(?:Rd|Road|St|Street|Ave|Avenue|Blvd|Dr|Drive|Lane|Ln|Way|Hwy|Pkwy)\b"]
    texts = {r.doc_id: r.text for r in view(spark, str(tmp_path), "texts").collect()}
    want = {i + 1_000_000: sum(bool(re.search(p, t)) for p in patterns) for i, t in texts.items()}
    got = {r.seq: r.n_fields for r in registry.queries()["findings_collected"](spark, str(tmp_path)).collect() if r.seq >= 1_000_000}
    assert got and got == {k: want[k] for k in got} and max(got.values()) == 4
    found = registry.queries()["dossiers"](spark, str(tmp_path)).where("office_phone is not null").collect()
    # what a snippet starts with has phones too, all of them others
    assert {r.office_phone[:10] for r in found} >= {"408-555-78"}


def test_dossiers_read_whole_pages(spark):
    from factloom.operators import collect

    # what tells something stands behind the 5,000th character, of an address behind the 10,000th
    page = "<title>T</title><p>" + "plain words " * 1000 + "</p>{}"
    tails = ["<p>Founded in 1911. Watch our livestream, donate by Pushpay</p>", "<p>Call (330) 555-0100 or write to office@x.org</p>", "<p>Ann Lee - Lead Pastor</p>", f"<a href='mailto:{'a' * 10_000}@x.org'>m</a>"]
    kinds = ["home", "sermons", "staff", "contact"]
    rows = [(i, i, f"https://x.org/{i}", 200, k, page.format(t)) for i, (k, t) in enumerate(zip(kinds, tails))]
    found = collect.website_findings(spark.createDataFrame(rows, "entity_id int, seq int, url string, status int, category string, html string"))
    body = {r.entity_id: r.body for r in found.collect()}
    assert all(len(b) > 12_000 for b in body.values()) and body[2].endswith("STAFF CARDS: Ann Lee — Lead Pastor")
    facts = {(r.entity_id, r.field_name): r.value for r in collect.fact_candidates(found.where("entity_id <> 2")).collect()}
    assert facts[0, "founded_year"] == "1911" and facts[0, "giving_provider"] == "Pushpay" and facts[1, "office_phone"] == "(330) 555-0100"
    d = {r.entity_id: r for r in collect.dossiers(found).collect()}
    assert [d[0].founded_year, d[0].signals_detected, d[1].office_email, d[1].office_phone] == ["1911", 3, "office@x.org", "(330) 555-0100"]
    assert d[2].lead_pastor == "Ann Lee" and d[3].office_email == "a" * 10_000 + "@x.org"


def test_stores(spark, tmp_path):
    from factloom.sources import stores

    (tmp_path / "db.json").write_text('{"churches": [{"id": "1", "name": "Oak"}], "runs": []}')
    assert [r.name for r in stores.read_store(spark, str(tmp_path / "db.json"), "entities", "id: string, name: string").collect()] == ["Oak"]
    assert stores.read_store(spark, str(tmp_path / "db.json"), "runs", "id: string").count() == 0
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "e1.json").write_text('{"_note": "x", "city": "Lima", "staff_count": {"value": 12, "confidence": 60}}')
    got = {(r.entity_id, r.key, r.value, r.confidence) for r in stores.read_field_maps(spark, str(tmp_path / "maps")).collect()}
    assert got == {("e1", "city", "Lima", None), ("e1", "staff_count", "12", 60.0)}


def test_links_and_redirects(spark):
    from factloom.functions import html as H
    from factloom.functions import urls as U

    rows = [("/a#x", "https://H.org/b/c?d", "https://H.org/a"), ("e", "https://h.org/b/c", "https://h.org/b/e"), ("//k.org/z", "https://h.org", "https://k.org/z"), ("mailto:x@y", "https://h.org", "mailto:x@y"), ("e", "https://h.org", "https://h.org/e")]
    df = spark.createDataFrame(rows, "href string, base string, want string")
    assert df.where(U.resolve(F.col("href"), F.col("base")) != F.col("want")).count() == 0
    r = spark.createDataFrame([("/l/?uddg=https%3A%2F%2Fa.org%2F&x=1",), ("//b.org",), ("https://c.org",)], "h string")
    assert [x[0] for x in r.select(U.decode_redirect(F.col("h"))).collect()] == ["https://a.org/", "https://b.org", "https://c.org"]
    one = spark.createDataFrame([("<b>A</b>&amp;lt; &NBSP;x", "see https://www.facebook.com/p?x, and youtu.be/1")], "s string, t string")
    got = one.select(H.strip_tags(F.col("s")).alias("a"), H.social_links(F.col("t")).alias("b"), H.has_contact_signal(F.col("t")).alias("c")).first()
    assert got.a == "A&lt; x" and got.b == ["https://facebook.com/p?x,", "https://youtu.be/1"] and not got.c
