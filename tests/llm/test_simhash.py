import random

import numpy as np
import pytest
import xxhash

from factloom.llm import simhash as sh
from factloom.llm.components import connected_components, local_roots


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    n = max(len(words) - 2, 1)
    h = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, codes):
    n = len(ids)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        r = find(i)
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(find(i)) for i in range(n)]


TEXTS = ["", None, " \t\n", "a", "A b", "a b c", "É x y\x1fz", "one two three four " * 400, "x " * 70_000]


def texts(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("the of and to in ab cd ef gh ij".split()) + str(rng.randrange(50)) for _ in range(300)) for _ in range(12)]
    out = list(TEXTS)
    for t in base:
        for _ in range(rng.randrange(6)):
            w = t.split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
            out.append(t)
    return out


def test_fingerprints():
    t = texts(1)
    got = sh.fingerprints([(x or "").encode() for x in t])
    assert [int(g) for g in got] == [plain(x) for x in t]


@pytest.mark.parametrize("fan,frontier", [(8, 2_000_000), (2, 50), (3, 700)])
def test_tree_finds_all_pairs(fan, frontier, monkeypatch):
    monkeypatch.setattr(sh, "FRONTIER", frontier)
    rng = random.Random(fan)
    codes = []
    for _ in range(60):
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            codes.append(c)
            c ^= 1 << rng.randrange(64)
    codes = list(dict.fromkeys(codes))
    groups = [rng.randrange(3) for _ in codes]
    left, right = sh.near_pairs(np.array(codes, np.uint64), np.array(groups), fan=fan)
    want = {(min(i, j), max(i, j)) for i in range(len(codes)) for j in range(i) if groups[i] == groups[j] and bin(codes[i] ^ codes[j]).count("1") <= 2}
    assert {(min(i, j), max(i, j)) for i, j in zip(left.tolist(), right.tolist())} == want
    assert len(left) == len(want)


def test_split_groups_lose_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    codes = {base}
    while len(codes) < 700:
        c = rng.choice(sorted(codes))
        codes.add(c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(40)))
    codes |= {rng.getrandbits(20) for _ in range(300)}
    codes = sorted(codes)
    signed = [sh._signed(c) for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fingerprint long")
    got = {r.fingerprint: r.root for r in connected_components(sh.fingerprint_links(df, group=40), "low", "high").select("node", "root").toDF("fingerprint", "root").collect()}
    want = components(signed, codes)
    assert [got.get(c, c) for c in signed] == want


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (1199, 1000), (None, 3)]
    rng.shuffle(edges)
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted((r.node, r.root) for r in rows) == [(i, 0) for i in range(301)] + [(1000 + i, 1000) for i in range(200)]
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
    assert local_roots(6, np.array([5, 3, 1]), np.array([3, 1, 2])).tolist() == [0, 1, 1, 1, 4, 1]


def test_documents(spark):
    t = texts(4)
    data = [(i * 3 % 101 + 5, x, "s") for i, x in enumerate(t)] + [(None, "one two three four " * 400, ""), (None, "lonely words here", ""), (7, "a", ""), (7, "a", "")]
    df = spark.createDataFrame(data, "doc_id long, text string, fingerprint string")
    rows = sh.near_duplicates(df).collect()
    codes = [plain(x[1]) for x in data]
    want = components([x[0] for x in data], codes)
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in rows))) == sorted(map(str, ((x[0], f"{c:016x}", w) for x, c, w in zip(data, codes, want))))
    kept = sh.drop_near_duplicates(df)
    assert kept.columns == df.columns
    # one for each component, the only all-null one included
    assert kept.count() == len({w for w in want})
    assert {r.doc_id for r in kept.collect()} == set(want)
    assert sh.near_duplicates(df.limit(0)).collect() == []


def test_tree_prunes_and_few_bits_lose_no_link(spark):
    rng = np.random.default_rng(8)
    codes = np.unique(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64))
    visited = []
    left, right = sh.near_pairs(codes, np.zeros(len(codes), np.int64), visited=visited)
    assert not len(left)
    # of the pairs that comparing all with all would take
    assert sum(visited) < 0.2 * len(codes) ** 2 / 2
    base = codes[:400]
    near = np.concatenate([base, base ^ np.uint64(1 << 5), base ^ np.uint64((1 << 61) | (1 << 40)), codes[400:1500]])
    near = np.unique(near)
    df = spark.createDataFrame([(int(c),) for c in near.view(np.int64)], "fingerprint long")
    got = {r.node: r.root for r in connected_components(sh.fingerprint_links(df, group=10_000, target=50), "low", "high").collect()}
    want = components([int(c) for c in near.view(np.int64)], [int(c) for c in near])
    assert [got.get(int(c), int(c)) for c in near.view(np.int64)] == want


def test_stage_with_clashing_names_and_repeats(spark):
    text = "one two three four five six"
    rows = [(5, text, 1, "a", None), (5, text, 0, "b", {"x": "1"}), (5, text, 0, "a", None), (7, text + " ", 3, "c", None), (None, None, 4, "d", None), (None, None, 4, "e", None), (9, "other words that stand here alone", 5, "f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, Kept_Hash string, root map<string,string>").withColumnRenamed("root", "fingerprint")
    want = [(5, 0, "a"), (9, 5, "f"), (None, 4, "d")]
    for most in (10, 0):
        out = sh.drop_near_duplicates(df, most_broadcast=most)
        assert out.schema == df.schema
        assert sorted(((r.doc_id, r.kept_id, r.Kept_Hash) for r in out.collect()), key=str) == want
    assert sh.drop_near_duplicates(df.limit(0)).collect() == []
