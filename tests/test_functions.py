import json
import time
"""Rules on values at and around their edges."""

import pytest
from pyspark.sql import functions as F

from factloom.config import CALIBRATION_FIELDS
from factloom.functions import confidence as C
from factloom.functions import extract as X
from factloom.functions import html as H
from factloom.functions import identity as I
from factloom.functions import scoring as S
from factloom.functions import urls as U
from factloom.operators import calibrate, jsonfix


def ask(spark, column, **values):
    """The value of an expression over one row of values."""
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def test_rounding_is_half_up(spark):
    assert [ask(spark, C.rounded(F.lit(x))) for x in (-2.5, 2.5, 0.49)] == [-2, 3, 0]


@pytest.mark.parametrize("score,gate,band,tier", [(85, "update", "strong-multi-source", "High"), (84.9, "review", "strong-multi-source", "High"), (60, "review", "plausible-incomplete", "Medium"), (59, "evidence_only", "weak-indirect", "Medium"), (34, "evidence_only", "insufficient", "Very Low"), (90, "update", "direct-official", "High")])
def test_gates(spark, score, gate, band, tier):
    s = F.lit(float(score))
    assert (ask(spark, C.decide_update(s)), ask(spark, C.confidence_band(s)), ask(spark, C.confidence_tier(s))) == (gate, band, tier)


def test_caps(spark):
    assert ask(spark, C.cap_confidence(F.lit(99.0), F.lit("search_snippets"))) == 65
    assert ask(spark, C.cap_confidence(F.lit(-3.0), F.lit("live_official_site"))) == 0
    assert ask(spark, C.clamp_confidence(F.lit(float("nan")))) == 0
    assert ask(spark, C.clamp_confidence(F.lit(55.555))) == 55.56


@pytest.mark.parametrize("attendance,want", [(None, 0), (0, 0), (10, 0), (1000, 66.7), (100_000, 100)])
def test_attendance_score(spark, attendance, want):
    assert round(ask(spark, S.attendance_sub_score(F.lit(attendance).cast("double"))), 1) == want


@pytest.mark.parametrize("name,want", [(None, 20), ("Unknown", 20), ("Southern Baptist", 75), ("searching", 75), ("independent", 45), ("other", 50)])
def test_network_score(spark, name, want):
    assert ask(spark, S.network_sub_score(F.lit(name).cast("string"), F.lit(None).cast("string"))) == want


@pytest.mark.parametrize("url,host,path", [("https://WWW.A.org/X?y#z", "a.org", "/x"), ("http://u@b.com:80", "b.com", "/"), ("nothing", "", ""), (None, "", "")])
def test_hosts(spark, url, host, path):
    u = F.lit(url).cast("string")
    assert (ask(spark, U.host_of(u)), ask(spark, U.path_of(u))) == (host, path)


def test_urls(spark):
    assert ask(spark, U.normalize_url(F.lit(" Example.org "))) == "https://example.org/"
    assert ask(spark, U.normalize_url(F.lit("https://"))) is None
    assert ask(spark, U.is_directory(F.lit("https://oklahomachurches.com/x")))
    assert ask(spark, U.is_directory(F.lit("garbage")))
    assert not ask(spark, U.is_directory(F.lit("https://mychurch.com/")))
    got = ask(spark, U.classify_result(F.lit("https://www.facebook.com/x"), F.lit("own.org")))
    assert (got.source_type, got.access_level, got.reliability) == ("facebook", "search_snippets", 0.55)
    assert ask(spark, U.classify_result(F.lit("https://own.org/x"), F.lit("own.org"))).source_type == "official_site"
    assert ask(spark, U.classify_result(F.lit("https://bigbuilders.com/"), F.lit(None).cast("string"))).access_level == "vendor_reference"


def test_html(spark):
    html = F.lit("<title> A\n B </title><style>p{}</style><!-- no --><p>x&nbsp;y</p><a href='/About'>Us <b>now</b></a><a href=\"javascript:0\">z</a><a href='mailto:a%40b.org?x'>m</a>")
    assert ask(spark, H.visible_text(html)) == "A B x y Us now z m"
    assert ask(spark, H.title(html)) == "A B"
    found = ask(spark, H.links(html))
    assert [(x.href, x.text) for x in found] == [("/About", "Us now"), ("mailto:a%40b.org?x", "m")]
    assert ask(spark, H.addresses(H.links(html), "mailto")) == ["a@b.org"]
    assert ask(spark, H.categorize(F.lit("/x"), F.lit("What We Believe"))) is None
    assert ask(spark, H.categorize(F.lit("/our-mission-vision"), F.lit(""))) == "beliefs"
    long_ = F.concat(F.lit("<div id='root'></div><p>"), F.repeat(F.lit("word "), 200), F.lit("</p><a href='x'>staff</a>"))
    assert ask(spark, H.is_thin(long_, H.visible_text(long_)))
    assert ask(spark, H.gain_ratio(F.lit(5), F.lit(0))) == 99


@pytest.mark.parametrize(
    "text,year,conf",
    [("Founded in 1950 here", 1950, 70), ("est. 2030", None, None), ("celebrating 50 years in 2019", 1969, 64), ("its 20th anniversary in 2020", 2000, 64), ("no year", None, None)],
)
def test_founded_year(spark, text, year, conf):
    y, c = X.founded_year(F.lit(text))
    assert (ask(spark, y), ask(spark, c)) == (year, conf)


def test_text_facts(spark):
    text = "Three campuses, a team of 12. Lead Pastor: John Adams. Ways to give with Pushpay. Mail bob@x.org or info@x.org, (330) 555-0100."
    rows = X.text_facts(spark.createDataFrame([(1, text)], "k int, text string"), ["k"], F.col("text"), F.lit("https://x.org")).collect()
    got = {r.field_name: (r.value, r.confidence) for r in rows}
    assert got["campus_count"] == ("3", 65) and got["multi_site"] == ("true", 65) and got["staff_count"] == ("12", 58)
    assert got["giving_provider"] == ("Pushpay", 55) and got["office_email"] == ("info@x.org", 60) and got["office_phone"] == ("(330) 555-0100", 55)
    assert got["lead_pastor"][0] == "John Adams"


def test_patterns_of_runs(spark):
    texts = ["a@b.co_c@d.org x@y", "é.ann@x.de,bob@@y.org", "9John Q. Adams, lead pastor", "ÉAnn  Lee is our lead pastor Bo", "lead pastor: Al Bo-Cy Dee|lead pastor", "a B lead pastor Ann", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    shapes = [r"(?i){}\s+(?:is\s+our\s+)?lead\s+pastor", r"(?i)lead\s+pastor[\s:]+{}", r"(?i){}[\s,\-–|]+lead\s+pastor"]
    every = lambda name, mail: F.array(F.regexp_extract_all("t", F.lit(mail), 0), *(F.regexp_extract_all("t", F.lit(s.format(name)), 1) for s in shapes))
    got = df.select(every(X.NAME_OF_RUNS, X.EMAIL_OF_RUNS).alias("a"), every(X.NAME, X.EMAIL).alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(len(x) for r in got for x in r.a) >= 8


def test_identity(spark):
    assert ask(spark, I.tokens(F.lit("First Church of the Oak-Hill, 3 X"))) == ["oak", "hill"]
    assert ask(spark, I.has_phrase(F.lit("Welcome to Oak Hill!"), F.lit("Oak Hill")))
    assert not ask(spark, I.has_phrase(F.lit("Oak"), F.lit("Oak")))
    words = F.array(F.lit("oak"), F.lit("hill"))
    assert ask(spark, I.name_match(F.lit("Oakland news"), F.lit("hillside.org"), words)) == 1
    assert ask(spark, I.location_status(F.lit("Oak, TX"), F.lit(""), F.lit("Lima"), F.lit("OH"))) == "conflict"
    assert ask(spark, I.location_status(F.lit("x"), F.lit("in lima today"), F.lit("Lima"), F.lit("OH"))) == "match"
    guesses = ask(spark, I.domain_guesses(F.lit("First Church of Oak Hill"), F.lit("Lima"), F.lit(None).cast("string")))
    assert guesses[0] == "https://www.oakhill.org" and len(guesses) == 20 and len(set(guesses)) == 20
    assert ask(spark, I.tokens(F.lit("Iglesia Peña CAFÉ Łódź"))) == ["pen", "cafe", "dz"]


def identity(spark, **over):
    base = dict(reachable=True, parked=False, usable_name=True, kind="official", provided=False, strong=True, ratio=1.0, place="match", content=True, ownership=2) | over
    return ask(spark, I.identity_score(**{k: F.lit(v) for k, v in base.items()}))


def test_identity_scores(spark):
    assert identity(spark) == 95
    assert identity(spark, provided=True) == 100
    assert identity(spark, usable_name=False) == 0
    assert identity(spark, kind="vendor_reference") == 15
    assert identity(spark, kind="general_directory") == 44
    assert identity(spark, strong=False, ratio=0.5, place="unknown", ownership=0) == 44
    assert identity(spark, strong=False, ratio=0.2, place="conflict") == 0


@pytest.mark.parametrize(
    "key,a,b,want",
    [("staff_count", "14", "10", True), ("staff_count", "14.1", "10", False), ("avg_weekly_attendance", "1.2k", "1,000", True), ("multi_site", "yes", "true", True), ("multi_site", "maybe", "true", False),
     ("lifecycle_stage", "Growing!", "growing", True), ("city", "New Haven", "haven", True), ("city", "ny", "nyc", False), ("campus_count", "2", "2", True), ("city", "", "x", False)],
)
def test_values_equal(spark, key, a, b, want):
    kind, tol = next((t, tol) for k, t, tol, _ in CALIBRATION_FIELDS if k == key)
    assert ask(spark, calibrate.values_equal(F.lit(kind), F.lit(tol).cast("double"), F.lit(a), F.lit(b))) is want


@pytest.mark.parametrize(
    "args,want",
    [((800, None, 3, 50, 50, "growing"), "Multi-Campus Church"), ((2500, None, None, 50, 50, "plateaued"), "Plateaued Mega Church"), ((None, None, None, None, None, "relaunch_revitalization"), "Revitalization Church"),
     ((None, None, None, None, None, "established"), "Healthy Regional Church"), ((100, 300, None, 80, 10, ""), "Influence Platform"), ((150, None, None, 0, 60, ""), "Church Plant"), ((300, None, None, 0, 0, "declining"), "Reverting Church"),
     ((300, None, None, 0, 0, ""), "Legacy Church"), ((900, None, None, 0, 70, ""), "Growth Church"), ((None, None, None, None, None, ""), "Unclassified")],
)
def test_archetypes(spark, args, want):
    columns = [F.lit(a).cast("double") for a in args[:5]] + [F.lit(args[5])]
    assert ask(spark, calibrate.archetype(*columns)) == want


@pytest.mark.parametrize(
    "raw,want",
    [('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('so: {"a":1} and {"b":2}', '{"a":1}'), ('{"a":1,"b":', '{"a":1,"b":null}'), ('{"a":1,"b', '{"a":1}'), ('{"a":"hel', '{"a":"hel"}'), ('{"a":"x}\\"y"} tail', '{"a":"x}\\"y"}'), ("nothing", None), ("", None)],
)
def test_json_repair(raw, want):
    assert jsonfix.loose_json(raw) == want


@pytest.mark.parametrize("raw,want", [("very low", 20), ("Low", 35), ("moderate", 55), ("HIGH", 80), ("300 people", 300), ("7", 7), ("", None), ("none", None), (None, None)])
def test_coerce_number(spark, raw, want):
    assert ask(spark, jsonfix.coerce_number(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [("growing", "growing"), ("momentum", "growing"), ("re-planted: replant", "relaunch_revitalization"), ("a new church", "plant"), ("flat", "plateaued"), (None, "unknown")])
def test_stages(spark, raw, want):
    assert ask(spark, jsonfix.coerce_stage(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw,want", [
    ('{"a":1}', '{"a":1}'), ('```json\n{"a":1}\n```', '{"a":1}'), ('Sure! {"a":1} hope that helps', '{"a":1}'), ('{"a":1}\n{"b":2}', '{"a":1}'), ('{"a":1,"b":', '{"a":1,"b":null}'),
    ('{"a":1,"b', '{"a":1}'), ('{"a":"hel', '{"a":"hel"}'), ('{"a": NaN}', None), ('[1, Infinity]', "[1]"), ('[-Infinity]', None), ('{"a": tru', None), ('{"a": [1, 2, {"b": "c\\u00', '{"a": [1, 2]}'),
    ('{"a": "x\\', None), ('{"a": [1, 2', '{"a": [1, 2]}'), ('{"a": 1, "b": foo, "c": 2}', '{"a": 1}'), ("[1, 2,", "[1, 2]"), ("[", "[]"), ("42", "42"), ("nothing", None), ("", None), ('{"a"}', None),
    ('["}", "]"', '["}", "]"]'), ("[[1], [2]] [3]", "[[1], [2]]"), ('{"a":1,}', '{"a":1}'), ('{"a" : {} , "b":[ ] }x', '{"a" : {} , "b":[ ] }'), ("[01]", None), ('{"a": "line\nbreak', None),
    ("{'a':1}", None), ('{"a" 1}', None), ('see {curly} then {"a":1}', None), ('{"a": {"b": tru', '{"a": null}'), ('[1, [tru', "[1]"), ('[[x', "[]"), ('{"a": "x, y" 1}', '{"a": "x"}'), ('{"a": 1, "b,c" 2}', '{"a": 1}'),
    ('{"a": "p, q\nr"}', '{"a": "p"}'), ('{"a": "{x", "b": nul}', '{"a": "{x"}'), ('{"x": [1, 2}, "y": 3', '{"x": [1]}'), ('{"a": bad' + ", 1" * 600, None), ('{"a": 1, "b": bad' + ", 1" * 490, '{"a": 1}'), ('{"a": 1, "b": bad' + ", 1" * 600, None),
    ('{"k": 1, "s": "a\\", b" x', '{"k": 1, "s": "a\\""}'), ('{', "{}"), ('{"a": 1', '{"a": 1}'), ('{"a"', None), ('{"a": 1, "b"', '{"a": 1}'),
])
def test_json_is_completed_or_cut(raw, want):
    got = jsonfix.loose_json(raw)
    assert got == want
    if got is not None:
        json.loads(got)


def test_json_repair_is_linear_and_bounded():
    begin = time.perf_counter()
    cut = '{"fields": [' + '{"name": "x", "value": "yyyyyyyyyyyyyyyyyy"}, ' * 5700 + '{"name": '
    assert len(cut) > 259_000 and len(json.loads(jsonfix.loose_json(cut))["fields"]) == 5701
    assert jsonfix.loose_json('{"a": "' + "z" * 300_000) is not None
    assert time.perf_counter() - begin < 1
    for mark in ("[", '{"a":', '[{"a":'):
        assert jsonfix.loose_json(mark * 200_000) is None
    assert json.loads(jsonfix.loose_json("[" * 900)) is not None


def test_word_bounds_are_ascii(spark):
    row = spark.createDataFrame([("1200 Main Street is where we meet. Städte", "ä330-555-0100", "Die éLead Pastoré", ", OHé")], "a string, p string, t string, s string")
    facts = row.select(X.snippet_facts(F.lit("x"), F.concat_ws(" ", "a", "p", "t")).alias("f"), I.states_in(F.col("s")).alias("s"), H.has_contact_signal(F.col("p")).alias("c")).first()
    assert {f.field_name: f.value for f in facts.f} == {"address": "1200 Main Street is where we meet. St", "phone": "330-555-0100", "lead_pastor_title_mention": "Lead Pastor"} and facts.s == ["OH"] and facts.c


def test_word_bounds_are_those_of_ascii_patterns():
    import random
    import re

    rng = random.Random(5)
    pieces = ["team of", " ", "3", "5 staff", "campus pastor", "all our campuses", "multisite", "our app", "give now", "donate", "/give", "realm", "daf", "podcast", "ä", "_", "-", ".", "(330) 555-0100", "1200 Main St", "celebrated", "in 1990", "est. 1901"]
    patterns = [p for _, p in X.SIGNALS + X.PLATFORMS] + [X.PHONE, r"\b\d{2,6}\s+[A-Z][A-Za-z0-9 .]+\b(?:Rd|St)\b", r"\b((?:19|20)\d{2})\b", r"\b(\d+|one)\s+(?:campuses|sites)\b", r"\bmulti-?site\b|\ball (?:our )?(?:campuses|locations)\b"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 6)))
        for p in patterns:
            want, got = re.search(p, text, re.A), re.search(X.ascii_bounds(p), text, re.A)
            assert (want and want.span()) == (got and got.span()), (p, text)


def test_repair_holds_few_texts_at_a_time(spark):
    rows = spark.createDataFrame([('{"a": 1',), (None,), ("no json",), ('x {"b": [1, 2]} y',)], "raw string").select(jsonfix.repair_json("raw").alias("json"))
    assert [r.json for r in rows.collect()] == ['{"a": 1}', None, None, '{"b": [1, 2]}']
    # Arrow's batches grow with the table up to some thousand texts
    plan = rows._jdf.queryExecution().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_facts_of_a_text_are_found_once(spark):
    rows = spark.createDataFrame([(1, "EST.\t1901, one campus. Team of 12; our\tapp. Give NOW. SENIOR Pastor: Ann Lee", "https://a.org"), (2, "We celebrated 20 years in 2019; three sites, campus pastor", "https://a.org/give"), (3, None, "u")], "id int, t string, u string")
    got = X.text_facts(rows, ["id"], F.col("t"), F.col("u"))
    facts = {(r.id, r.field_name): (r.value, r.confidence) for r in got.collect()}
    assert facts[1, "founded_year"] == ("1901", 70.0) and facts[1, "campus_count"] == ("1", 55.0) and facts[1, "staff_count"] == ("12", 58.0) and facts[1, "app_status"] == ("active", 55.0)
    assert facts[1, "online_giving_present"] == ("true", 60.0) and facts[1, "lead_pastor"] == ("Ann Lee", 55.0)
    assert facts[2, "founded_year"] == ("1999", 64.0) and facts[2, "campus_count"] == ("3", 65.0) and facts[2, "multi_site"] == ("true", 65.0) and facts[2, "online_giving_present"] == ("true", 60.0)
    # the patterns of years and of campuses are tried once (an empty match counts as none, so they stand there twice)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("began|founded") <= 2 and plan.count("campuses|locations|sites") <= 2
