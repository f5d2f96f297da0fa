import zlib

import pytest

from factloom.llm import sharding


def check(rows, n, shards):
    assert len(rows) == n
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for v in slots.values():
        assert sorted(v) == list(range(len(v)))


@pytest.mark.parametrize("n", [1, 2, 7, 100, 1003])
def test_permutation_is_one_with_cycle_walking(spark, n):
    from pyspark.sql import functions as F

    sides = (sharding.isqrt(n) + 3, sharding.isqrt(n) + 4)  # many spare cells
    for s in (None, sides):
        got = [r.p for r in spark.range(n).select(sharding.permute(F.col("id"), n, sides=s).alias("p")).collect()]
        assert sorted(got) == list(range(n))


def test_places(spark):
    data = [(i, f"text {i % 5}" if i % 7 else None, i) for i in range(500)] + [(None, "x", 1)] * 90 + [(9, "", 0)] * 3
    df = spark.createDataFrame(data, "doc_id long, text string, slot int")
    rows = sharding.assign_shards(df, shards=7).collect()
    check(rows, len(data), 7)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in data)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == want
    again = sharding.assign_shards(df.repartition(5), shards=7).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(df).collect() == []


def test_copies_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 10)
    df = spark.createDataFrame([(1, "a")] * 95 + [(2, "b")] * 10, "doc_id long, text string")
    check(sharding.assign_shards(df, shards=4).collect(), 105, 4)
