import random
import re
from collections import Counter, defaultdict

import pytest

from factloom.llm import source_divergence as s


def brute(rows, least=30):
    used, groups = defaultdict(Counter), set()
    docs = defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        used[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = []
    for lang, source in groups:
        kept = [t for t, k in docs[lang].items() if k >= least]
        names = sorted((x for g, x in groups if g == lang), key=lambda x: x.encode())

        def shares(n):
            below = sum(n[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 5) // below for t in kept}

        every = shares(sum((used[lang, x] for x in names), Counter()))
        p = {x: shares(used[lang, x]) for x in names}
        pairs = [(-sum(abs(p[source][t] - p[x][t]) for t in kept), x.encode(), x) for x in names if x != source]
        terms = [(every[t] - p[source][t], t.encode(), t) for t in kept if used[lang, source][t] and p[source][t] > every[t]]
        for part, told in (("pair", sorted(pairs)), ("term", sorted(terms)[:50])):
            found += [(lang, source, part, item, -v, i) for i, (v, _, item) in enumerate(told, 1)]
    return sorted(map(str, found))


def sample(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Über", "über", "漢字", "漢", "\U0001f600x", "é", "é", "ABC", "abc", "ab", "a"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "hot", "s1", "s2", None, "", "é"])
        rows.append((lang, source, rng.choice([" ", "1", "\n", "_-"]).join(rng.choice(words[len(source or "") % 2 :]) for _ in range(rng.randrange(60)))))
    return rows + [("fr", "x", "nothing kept here"), ("fr", "y", None), ("xx", "alone", ""), ("en", "textless", None), ("en", "textless", " 12 ")] + rows[:20] * 3


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 3, "x", "y") for r in rows], "lang string, source string, text string, n int, TERM string, Part string").repartition(5)
    got = s.source_divergence(df, **options)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, options.get("least_docs", 30))


def test_against_brute_force(spark):
    check(spark, sample(1))
    check(spark, [])
    check(spark, [(None, None, None)])


def test_small_bounds(spark, monkeypatch):
    for name, value in (("MOST_LEAVES", 30), ("ROWS", 7), ("CHUNK", 16), ("SLICE_BYTES", 900)):
        monkeypatch.setattr(s, name, value)
    batches = [spark.createDataFrame(sample(2), "lang string, source string, text string").toArrow().combine_chunks().to_batches()[0]]
    rows = [r for b in s._count(iter([_filled(batches[0])])) for r in b.to_pylist()]
    monkeypatch.undo()
    whole = [r for b in s._count(iter([_filled(batches[0])])) for r in b.to_pylist()]
    assert len(rows) > len(whole)

    def summed(found):
        total = defaultdict(lambda: [0, 0])
        for r in found:
            total[r["lang"], r["term"], r["source"]][0] += r["docs"]
            total[r["lang"], r["term"], r["source"]][1] += r["n"]
        return dict(total)

    assert summed(rows) == summed(whole)


def _filled(batch):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pa.RecordBatch.from_arrays([pc.fill_null(c, "") for c in batch.columns], names=batch.schema.names)


def test_blocks_of_sources(spark, monkeypatch):
    rows = sample(3, 300)
    one = _Collected()
    monkeypatch.setattr(s, "MOST_CELLS", 14)
    monkeypatch.setattr(s, "CELLS", 40)
    # the traversal itself, for each block, as its tasks would do it
    kept, groups = ["a", "b", "zz"], [{"source": f"s{i}", "n": 7 + i} for i in range(6)]
    counters = [[{"source": "s1", "n": 4}, {"source": "s5", "n": 2}], [{"source": "s0", "n": 9}], [{"source": x["source"], "n": 1} for x in groups]]
    for block in range(3):
        lang = s._Language("en", groups, 60, 3, block)
        assert len(lang.block) == 2
        lang.add([t.encode() for t in kept], [6, 9, 6], counters)
        one.add(lang)
    monkeypatch.undo()
    all_ = s._Language("en", groups, 60, 3, 0)
    all_.add([t.encode() for t in kept], [6, 9, 6], counters)
    two = _Collected()
    two.add(all_)
    assert sorted(one.rows) == sorted(two.rows) and rows


class _Collected:
    def __init__(self):
        self.rows = []

    def add(self, lang):
        self.rows += [str(r) for b in lang.rows() for r in b.to_pylist()]


def test_tries_merge_and_traverse_in_order_of_bytes():
    rng = random.Random(4)
    parts, want = [], defaultdict(lambda: [0, 0])
    for _ in range(6):
        rows = {}
        for _ in range(500):
            rows[rng.choice("xy"), "".join(rng.choice("abé\uffff\U0001f600") for _ in range(rng.randrange(7))), rng.choice("12")] = [1, rng.randrange(9)]
        for key, (docs, n) in rows.items():
            want[key][0] += docs
            want[key][1] += n
        keys = list(rows)
        parts.append(s._leaves([k[0] for k in keys], [k[2] for k in keys], s.pa.array([k[1] for k in keys]), [v[0] for v in rows.values()], [v[1] for v in rows.values()]))
    got = s.Trie.merged(parts).traverse().to_pylist()
    order = sorted(want, key=lambda k: (k[0], k[1].encode(), k[2]))
    assert [((r["lang"], r["term"], r["source"]), [r["docs"], r["n"]]) for r in got] == [(k, want[k]) for k in order]


def test_long_texts_count_once_and_whole(monkeypatch):
    text = " ".join(f"Wort{i % 701} é{i % 13}" for i in range(9000))
    array = s.pa.array(["x", None, text, ""]).slice(2, 1)
    want = s.count_terms(["de"], ["s"], array).sort_by("term").to_pylist()
    monkeypatch.setattr(s, "CHUNK", 50)
    assert s._count_long("de", "s", array).sort_by("term").to_pylist() == want
    assert s.count_terms([], [], s.pa.array([], s.pa.string())).num_rows == 0


@pytest.mark.parametrize("below", [7, 10**9 + 7, s.EXACT, 10**17])
def test_shares_are_exact(below):
    import numpy as np

    counts = np.array([0, 1, below // 3, below - 1, below])
    assert s._shares(counts, np.array([below])).tolist() == [1 + 10**9 * int(c) // below for c in counts]
