import random
import zlib

import numpy as np

from factloom.llm import language_id as lid


def plain_phrases(sample, symbols, block=lid.BLOCK):
    """Greedy cross-parsing by substring search."""
    source, n = bytes(sample), 0
    for a in range(0, len(symbols), block):
        part, i = bytes(symbols[a : a + block]), 0
        while i < len(part):
            j = i + 1
            if part[i:j] in source:
                while j < len(part) and part[i : j + 1] in source:
                    j += 1
            n += 1
            i = j
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(3)
    samples = {k: ["".join(rng.choice(k + " ") for _ in range(400))] for k in ("abcd", "cdef")}
    model = lid.Model(samples)
    texts = ["".join(rng.choice("abcdefxyz ,1É") for _ in range(rng.choice([0, 1, 5, 300, 1000]))) for _ in range(40)] + ["", "1 2", "zzz"]
    sizes, counts = model.phrases(texts)
    for t, n, c in zip(texts, sizes, counts):
        symbols = model.symbols(t)
        if not any(ch.isalpha() for ch in t):
            assert n == 0 and not c.any()
            continue
        assert n == len(symbols)
        for k, name in enumerate(model.languages):
            sample = model.symbols("\n".join(samples[name]))[: lid.SAMPLE_SYMBOLS]
            assert c[k] == plain_phrases(sample.tolist(), symbols.tolist())


def accuracy(spark, path):
    docs = spark.read.parquet(path)
    rows = lid.identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    return np.mean([r.lang_pred == r.lang for r in rows]), rows


def test_held_out_accuracy(spark):
    share, rows = accuracy(spark, "/root/testdata/sf0.01/documents.parquet")
    assert len(rows) > 200
    assert share > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lid, "SLICE_BYTES", 100)
    data = [(i, "the and of " * 9, "en", "x") for i in range(40)] + [(100 + i, "der die und " * 9, "de", "y") for i in range(40)]
    odd = [(1000, None, "en", ""), (1001, "", None, ""), (1002, "12 ... %", "en", ""), (None, "the of the and", None, ""), (1003, "и", "en", ""), (1004, "die der " * 50_000, None, ""), (1004, "the", None, "")]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, lang string, score string")
    rows = lid.identify_languages(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.lang_pred)
    assert len(rows) == len(data) + len(odd)
    assert [got[i] for i in (1000, 1001, 1002)] == [["und"]] * 3
    assert got[None] == ["en"] and sorted(got[1004]) == ["de", "en"]
    assert got[1003][0] in ("de", "en")
    kept = lid.drop_unknown_language(df)
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - 3
    blank = df.limit(0)
    assert lid.identify_languages(blank).collect() == []
    assert {r.lang_pred for r in lid.identify_languages(df.withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()} == {"und"}


def test_scripts_of_many_letters_are_told_apart(spark):
    """Two languages of 400 letters each, beside one of few: no letter is lost."""
    rng = random.Random(6)
    signs = [chr(0x4E00 + i) for i in range(1200)]
    scripts = {"aa": signs[:400], "bb": signs[400:800], "cc": list("abcdefgh")}
    line = lambda s, n: "".join(rng.choice(s) + " " * (rng.random() < 0.3) for _ in range(n))
    model = lid.Model({k: [line(s, 3000)] for k, s in scripts.items()})
    assert len(model.alphabet) > 790
    for k, s in scripts.items():
        assert {lang for lang, _ in model.predict([line(s, 40) for _ in range(20)])} == {k}
    # letters that no labelled text has are one symbol and tell nothing apart
    sizes, counts = model.phrases([line(signs[800:], 50)])
    assert sizes[0] > 0 and len(set(counts[0])) == 1
    data = [(i, line(scripts["aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]], 60), "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]) for i in range(120)]
    rows = lid.identify_languages(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == data[r.doc_id][2] for r in rows) and any(r.held_out for r in rows)


def test_very_many_languages():
    rng = random.Random(2)
    samples = {f"l{i:03d}": ["".join(rng.choice("abcdefghij"[i % 7 : i % 7 + 3]) for _ in range(60))] for i in range(300)}
    model = lid.Model(samples)
    assert len(model.languages) == 300 and model.predict([samples["l004"][0]])[0][0] in samples
