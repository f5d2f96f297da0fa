import random
import re

import numpy as np
import pyarrow as pa

from factloom.llm import toxicity as tox


def test_words_and_windows():
    texts = ["", "12 %", "One two", "É漢 a1b", "w " * 100, "x" * 300, "the End"]
    words = tox.Words(pa.array(texts))
    plain = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.lower()) for t in texts]
    assert np.diff(words.upto, prepend=0).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert words.n == len(set(flat))
    same = {}
    for w, k in zip(flat, words.which):
        assert same.setdefault(w, k) == k
    for w, k in same.items():
        marked = b"<" + w.encode() + b">"
        want = 1 + sum(max(len(marked) - n + 1, 0) for n in tox.GRAMS)
        assert (words.owner == k).sum() == want
    grid, text = words.windows()
    seen = {}
    for row, t in zip(grid, text):
        seen.setdefault(t, set()).update(row[row >= 0].tolist())
    assert {t: v for t, v in seen.items()} == {i: {same[w] for w in p} for i, p in enumerate(plain) if p}
    n = len(plain[4])
    assert (text == 4).sum() == 1 + -(-(n - tox.WINDOW) // tox.STRIDE)


def test_gradients():
    rng = random.Random(0)
    texts = ["".join(rng.choice("ab c") for _ in range(60)) for _ in range(6)]
    words = tox.Words(pa.array(texts))
    net = tox.Network(np.unique(words.hashes)[:40])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    _, owner, gram = net.embedded(words)
    order = np.argsort(owner, kind="stable")
    gram, bounds = gram[order], np.searchsorted(owner[order], np.arange(words.n + 1))
    grid, text = words.windows()
    y = np.array([0, 1, 1, 0, 1, 0])[text]
    _, grads = tox.loss_gradients(net, grid, y, gram, bounds)
    for name, w in net.weights.items():
        flat = w.reshape(-1)
        for i in rng.sample(range(len(flat)), min(4, len(flat))):
            old, e = flat[i], 2e-3
            flat[i] = old + e
            up = tox.loss_gradients(net, grid, y, gram, bounds)[0]
            flat[i] = old - e
            down = tox.loss_gradients(net, grid, y, gram, bounds)[0]
            flat[i] = old
            assert abs((up - down) / (2 * e) - grads[name].reshape(-1)[i]) < 2e-3, name


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = tox.fit(docs, labels, sample=600)
    rows = tox.score_toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels, net).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert len(rows) > 800
    assert hit / sum(r.toxic for r in rows) > 0.8
    assert hit / sum(r.predicted for r in rows) > 0.75
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_odd_rows(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["calm", "tree", "river", "stone", "cloud", "house"])
    data, marks = [], []
    for i in range(300):
        w = [word() for _ in range(80)]
        if i % 2:
            w[rng.randrange(80)] = "vilest"
        data.append((i, " ".join(w), "x"))
        marks.append((i, i % 2, 0))
    long_ = " ".join(word() for _ in range(30_000))
    odd = [(None, "calm vilest", ""), (1000, None, ""), (1001, "", ""), (1002, "1 2 3", ""), (1003, long_ + " vilest", ""), (1004, long_, ""), (1003, "calm", "")]
    df = spark.createDataFrame(data + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame(marks + [(None, 1, 0), (5, None, 0), (9999, 1, 0), (1, 1, 0)], "doc_id long, toxic int, quality int")
    rows = tox.score_toxicity(df, labels).collect()
    assert len(rows) == len(data) + len(odd)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r.predicted)
    assert got[None] == [1] and sorted(got[1003]) == [0, 1] and got[1004] == [0]
    assert got[1000] == got[1001] == got[1002]
    assert np.mean([got[i][0] == i % 2 for i in range(300)]) > 0.97
    assert tox.score_toxicity(df.limit(0), labels).collect() == []
    assert {r.predicted for r in tox.score_toxicity(df, labels.limit(0)).collect()} == {0}
