import re
from collections import Counter

import pytest

from factloom.llm import quality_rules as q

SPACE = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(SPACE, text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = Counter(windows)
    repeated = {p for i, x in enumerate(windows) if times[x] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "n_lines": len(lines),
        "n_letter_words": sum(bool(re.search(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]", x)) for x in w),
        "n_echo_words": sum(a == b for a, b in zip(w, w[1:])),
    }


TEXTS = [
    None, "", " \t\n", "one", "a b c d e f g h " * 2, "a b c d e f g h " * 2, "x " * 40, " nbsp is no space\x1cnor this",
    "é ü 漢字 \U0001f600\r\nline\nline\n\nline \n", "### $$$ | <b> & %", "\n".join(["same line of text here"] * 9), "1 2 3 4 5 6 7 8 9 10",
    "a b c d e f g h a b c d e f g", "w1 w2 w3 w4 w5 w6 w7 w8 " + "q " * 3 + "w1 w2 w3 w4 w5 w6 w7 w8", "\x00 nul \x00\x00", "a b\x85c\vd\fe",
    " ".join(f"w{i % 977}" for i in range(70_000)), "x" * 200_000,
]


def test_measures_against_brute_force(monkeypatch):
    for chunk in (3, 1 << 16):
        monkeypatch.setattr(q, "CHUNK", chunk)
        found = q.measure([(t or "").encode() for t in TEXTS])
        assert [{m: int(found[m][i]) for m in q.MEASURES} for i in range(len(TEXTS))] == [brute(t) for t in TEXTS]
    assert all(len(v) == 0 for v in q.measure([]).values())


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i if i % 5 else None, t, f"s{i % 2}", -1, "z") for i, t in enumerate(TEXTS)] + [(1, "", "s0", -1, "z")] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int, FAILURES string")


def test_ledger_policies_and_ablations(frame):
    ledger = q.rule_ledger(frame, carry=("source", "n_words", "FAILURES"))
    rows = [r.asDict() for r in ledger.collect()]
    assert len(rows) == len(TEXTS) + 3
    assert {"source", "n_words_", "FAILURES_", "failures"} <= set(rows[0])
    want = Counter()
    for t in TEXTS + [""] * 3:
        m = brute(t)
        want[sum(1 << i for i, r in enumerate(q.RULES) if eval(r.fails.replace(" AND ", " and "), {}, m))] += 1
    assert Counter(r["failures"] for r in rows) == want
    for r in q.apply_policies(ledger).collect():
        for p in q.POLICIES:
            assert r[f"kept_{p.version}"] == (r.failures & p.mask() == 0)
    for by in ((), ("source",)):
        told = q.ablations(ledger, by=by).collect()
        assert len(told) == sum(len(p.rules) for p in q.POLICIES) * (2 if by else 1)
        for r in told:
            policy = next(p for p in q.POLICIES if p.version == r.version)
            one = q.Policy("", (r.rule,)).mask()
            mine = [x["failures"] & policy.mask() for x in rows if not by or x["source"] == r.source]
            assert (r.n_docs, r.n_kept, r.n_failed, r.n_alone, r.n_kept_without) == (
                len(mine), sum(x == 0 for x in mine), sum(x & one != 0 for x in mine), sum(x == one for x in mine), sum(x & ~one == 0 for x in mine))


def test_own_rules_and_no_rows(frame):
    rules = (q.Rule("null", "n_words > NULL"), q.Rule("any", "n_words >= 0"))
    assert {r.failures for r in q.rule_ledger(frame, rules).collect()} == {2}
    empty = frame.limit(0)
    assert q.quality_digest(empty).collect() == []
    assert q.ablations(q.rule_ledger(empty)).collect() == []
    with pytest.raises(ValueError):
        q.rule_ledger(frame, rules * 32)


def test_digest_of_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = q.quality_digest(docs).join(labels, "doc_id").collect()
    assert all(r.kept for r in got if r.quality == 1 and not r.base_failed)
    bad = [r.kept for r in got if r.quality == 0]
    assert bad and sum(bad) <= 0.05 * len(bad)
