"""The pipeline's stages against brute force, each on its own input."""

import importlib.util
import zlib

import duckdb
import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline isn't there")

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from factloom.llm.common import materialize

    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "x", 0), (10**6 + 1, " 12 !", "en", "x", 5), (10**6 + 2, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(extra)
    out = {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, PATH), name)
        out[name] = docs
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(stages):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "decontamination", "pii", "packing"]
    assert all(stages[n].columns == stages["start"].columns for n in ("language_id", "simhash", "decontamination", "pii"))
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_drops_texts_without_letters(stages):
    before, after = rows(stages["start"]), rows(stages["language_id"])
    assert set(before) - set(after) == {10**6, 10**6 + 1, 10**6 + 2}


def test_simhash_stage_keeps_one_of_each_group(stages):
    from tests.llm.test_simhash import components, plain

    before = rows(stages["language_id"])
    ids = sorted(before)
    groups = components(ids, [plain(before[i].text) for i in ids])
    assert set(rows(stages["simhash"])) == set(groups)


def test_contaminated_documents_go(stages):
    from tests.llm.test_decontamination import brute

    items = duckdb.sql(f"SELECT item_id, text FROM '{PATH}/benchmark.parquet'").fetchall()
    before = rows(stages["simhash"])
    clean = {int(r[0]) for r in brute([(i, r.text) for i, r in before.items()], items) if not r[5]}
    assert set(rows(stages["decontamination"])) == clean


def test_pii_stage_keeps_documents_and_formats(stages):
    before, after = rows(stages["decontamination"]), rows(stages["pii"])
    assert set(before) == set(after)
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all(before[i].lang == after[i].lang for i in before)


def test_packing_holds_every_token(stages):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in stages["pii"].collect():
        ids = plain.encode(r.text, add_special_tokens=False).ids + [1]
        want += [(r.doc_id, a, zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for a in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in stages["packing"].collect()) == sorted(want)


def test_stages_over_odd_tables(spark):
    """An empty table, repeated rows, clashing names in both cases and a long text."""
    import corpus_pipeline

    start = spark.read.parquet(f"{PATH}/documents.parquet")
    one = start.where("length(text) > 500").orderBy("doc_id").first()
    long = " ".join(f"{one.text} {i}" for i in range(300))
    rows = [tuple(one)] * 3 + [(10**7, long, "en", "x", len(long)), (None, one.text + " and more of it", "en", None, None)]
    odd = spark.createDataFrame([(*r, 1, "kept", 2.5) for r in rows], start.schema.add("_ROW", "integer").add("Fingerprint", "string").add("N_WORDS", "double"))
    for docs, some in ((odd, True), (odd.limit(0), False)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES[:4]:
            docs = stage(spark, docs, PATH)
            assert docs.columns == names, name
        found = docs.collect()
        assert bool(found) == some and all((r["_ROW"], r["Fingerprint"], r["N_WORDS"]) == (1, "kept", 2.5) for r in found)
        packed = corpus_pipeline.STAGES[4][1](spark, docs, PATH).collect()
        assert {r.doc_id for r in packed} == {r.doc_id for r in found}


def test_run_leaves_only_what_is_read(spark):
    import corpus_pipeline
    from factloom.llm.common import written

    before = set(written(spark))
    assert corpus_pipeline.run(spark, PATH).count() > 0
    assert sum("/pii-" in p for p in set(written(spark)) - before) == 1 and not any(f"/{n}-" in p for p in set(written(spark)) - before for n in ("language_id", "simhash", "decontamination"))
