import hashlib
import random
import re

import pytest

from factloom.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        m = min(13, len(w))
        for i in range(len(w) - m + 1):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit.update(range(i, i + m))
                    # a window of a row without id is a hit of no item
                    found |= own - {None}
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 30, 400]))] + ["É", "Straße", "X1", "漢字"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - ", "_"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 3, 5, 12, 13, 14, 40]))) for i in range(25)]
    items += [(3, text(20)), (None, text(20)), (77, None), (101, items[6][1]), (102, items[7][1].upper())]
    docs = []
    for i in range(60):
        t = text(rng.choice([0, 3, 13, 50, 300]))
        for _ in range(rng.choice([0, 0, 1, 3])):
            src = words(rng.choice(items)[1])
            a = rng.randrange(len(src) + 1)
            piece = "; ".join(src[a : a + rng.choice([5, 12, 13, 14, 40])])
            t = t + "." + piece.title() + " " if rng.random() < 0.5 else piece + " " + t
        docs.append((i, t))
    docs += [(None, None), (5, docs[5][1]), (5, docs[6][1]), (900, ""), (901, "..."), (902, text(3000))]
    return docs, items


@pytest.mark.parametrize("seed,block", [(1, dec.BLOCK_BYTES), (2, dec.BLOCK_BYTES), (3, 300)])
def test_against_brute_force(spark, seed, block, monkeypatch):
    monkeypatch.setattr(dec, "SLICE_BYTES", 3000)
    docs, items = case(seed)
    d = spark.createDataFrame([(*x, "extra") for x in docs], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    rows = dec.contamination_digest(d, b, block_bytes=block).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    want = brute(docs, items)
    assert got == want
    kept = dec.drop_contaminated(d, b, block_bytes=block)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[5])


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    (row,) = dec.contamination_digest(d, b).collect()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
    assert dec.contamination_digest(d.limit(0), b).collect() == []


def test_against_sql(spark):
    import duckdb

    from factloom.llm.registry import oracle_sql, queries

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({oracle_sql()['op7_decontamination']})").fetchall())
    got = sorted(tuple(r) for r in queries()["op7_decontamination"](spark, path).collect())
    assert got == want
    assert any(r[2] for r in got)


@pytest.mark.parametrize("name", ["_row", "_ROW"])
def test_columns_of_any_case_stay_with_several_blocks(spark, name):
    docs = spark.createDataFrame([(1, "one two three", "kept"), (2, " ".join(f"w{i}" for i in range(20)), "gone")], f"doc_id long, text string, {name} string")
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20))), (2, "another item of some words")], "item_id long, text string")
    for size in (1 << 20, 10):
        left = dec.drop_contaminated(docs, items, block_bytes=size)
        assert left.columns == docs.columns and left.collect() == [(1, "one two three", "kept")]
