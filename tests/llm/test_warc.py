import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factloom.llm import warc
from factloom.llm.common import new_path

TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [
    (5, "http://a.example.com/x?y=1", "same"),
    (3, "http://www.b.example.com", "same"),
    (9, None, "same"),
    (1, "not a url", None),
    (2, "http://a.example.com/x", ""),
    (7, "http://a.example.com/\r\nX-Evil: 1", TRAP),
    (8, "http://u@a.example.com:80/p#frag", TRAP),
    (10, "http://é.example.com/ü", "é漢" * 3),
    (11, "http://a.example.com/x", "w" * 300_000),
    (None, "http://a.example.com/x", "alone"),
    (None, "http://c.example.com/x", "same"),
    (20, "http://d.example.com/", "twice"),
    (20, "http://d.example.com/", "twice"),
    (21, "http://d.example.com/", "twice"),
]


def want(pages):
    least = {}
    for i, _, p in pages:
        if i is not None:
            least[p or ""] = min(least.get(p or "", i), i)
    out = []
    for i, _, p in pages:
        b, first = (p or "").encode(), least.get(p or "")
        copy = first is not None and i != first
        out.append(str((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if copy else "response", first if copy else None)))
    return sorted(out)


@pytest.mark.parametrize("size", [warc.ARCHIVE_BYTES, 2000])
def test_round_trip(spark, size):
    rng = random.Random(size)
    pages = PAGES + [(100 + i, f"http://h{rng.randrange(4)}.example.com/{rng.randrange(9)}", "p" * rng.randrange(40)) for i in range(200)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, archive string")
    rows = warc.archive_round_trip(df, archive_bytes=size).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in rows) == want(pages)
    keys = [(r.url_key, r.captured_at, r.page_id is None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys)
    assert warc.archive_round_trip(df.limit(0)).collect() == []


def test_payloads_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = new_path(spark, "archives")
    warc.write_archives(df, path)
    rows = warc.read_archives(spark, path, with_payload=True).collect()
    texts = {i: (p or "").encode() for i, _, p in PAGES if i is not None}
    for r in rows:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload) == texts[r.page_id]
    assert {r.page_id: r.url for r in rows}[7] == "http://a.example.com/%0D%0AX-Evil: 1"


def test_damage_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:X\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    for data in (good, b"junk\r\n\r\n", good.replace(b"22", b"20")):
        with pytest.raises(ValueError):
            list(warc.parse_archive(data))


@pytest.mark.parametrize("seed", range(20))
def test_loser_tree(seed):
    rng = random.Random(seed)
    runs = [sorted(rng.randrange(9) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(9))]
    got = list(warc.merge_runs(runs))
    assert got == [(r, i) for _, r, i in sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))]


def test_null_ids_come_last_beside_zero(spark):
    url = "http://a.example.com/x"
    pages = [(i, url, f"p{n}") for n, i in enumerate([None, 0, None, -1, 100_000_000, None, 0])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warc.archive_round_trip(df).collect()
    assert [r.page_id for r in rows if r.captured_at == rows[0].captured_at] == [0, 0, 100_000_000, None, None, None]
    keys = [(r.captured_at, r.page_id is None, r.page_id or 0) for r in rows]
    assert keys == sorted(keys) and len(rows) == 7


def test_archives_end_by_bytes(spark):
    sizes = [10] * 300 + [5000] * 40 + [30_000] + [10] * 50
    df = spark.createDataFrame([(i, f"http://a.example.com/{i % 7}", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(2)
    path = new_path(spark, "archives")
    warc.write_archives(df, path, archive_bytes=8000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("length").collect()
    assert len(files) > 40 and sorted(f.length for f in files)[-2] < 8000 + 5000 + 2 * warc.RECORD_BYTES
    rows = warc.read_archives(spark, path)
    assert rows.count() == len(sizes) and rows.select("archive").distinct().count() == len(files)


def test_capture_dates_are_utc_in_every_zone(spark):
    seconds = spark.createDataFrame([(0,), (86_399,), (5 * 86_400 + 3661,), (99_999_999,)], "s long")
    want = ["2024-01-01T00:00:00Z", "2024-01-01T23:59:59Z", "2024-01-06T01:01:01Z", "2027-03-03T09:46:39Z"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert [r[0] for r in seconds.select(warc.capture_date(F.col("s"))).collect()] == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_hot_payload_refers_to_its_first_page(spark):
    rows = [(i, f"https://x{i % 7}.org/{i}", "" if i % 3 else f"<p>{i}</p>") for i in range(5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive_round_trip(df).collect()}
    assert got == {i: ("response", None) if i % 3 == 0 or i == 1 else ("revisit", 1) for i in range(5000)}
