import numpy as np
import pytest

from factloom.llm import embedding_dedup as ed


def brute(rows, threshold=ed.THRESHOLD):
    n = len(rows)
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    unit = [np.array(r[1], np.float32).astype(float) / np.linalg.norm(np.array(r[1], np.float32).astype(float)) if g else None for r, g in zip(rows, ok)]
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(str((r[0], k, least.get(find(i)), r[0] == least.get(find(i)))) for i, (r, k) in enumerate(zip(rows, links)))


def sample(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(16)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows) * 7 % 1009, v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
            v = v + rng.standard_normal(16) * 0.12
    odd = [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [1.0, None] * 8, 0), (2003, [float("nan")] + [1.0] * 15, 0), (2004, [float("inf")] + [1.0] * 15, 1), (2005, rows[0][1], None), (2006, [], 0), (2007, rows[0][1][:8], rows[0][2]), (None, rows[0][1], rows[0][2])]
    return rows + odd + [rows[3]] * 30 + [(5, rows[3][1], rows[3][2])]


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rows = sample(block, 120)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in ed.near_duplicate_embeddings(df, block=block).collect())
    want = brute(rows)
    assert len(got) == len(want)
    # pairs just at the threshold may be missed with the stated probability
    assert sum(a != b for a, b in zip(got, want)) <= 2
    assert ed.near_duplicate_embeddings(df.limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(3)
    x = ed._unit(rng.standard_normal((3000, 64)))
    side = rng.standard_normal((3000, 64))
    side = ed._unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.931 * x + np.sqrt(1 - 0.931**2) * side
    half, least = ed.window_and_count(0.93, ed.LINES, ed.RECALL)
    a, b = x @ ed._directions(64, ed.LINES, ed.SEED + 1), y @ ed._directions(64, ed.LINES, ed.SEED + 1)
    assert ((np.abs(a - b) <= half).sum(1) >= least).mean() > 0.999
    far = (np.abs(a[:-1] - a[1:]) <= half).sum(1) >= least
    assert far.mean() < 0.1
    tables, planes = ed.tables_and_planes(1 << 14, 0.93, 1024, ed.RECALL)
    h = ed._directions(64, tables * planes, ed.SEED)
    same = ((x @ h > 0) == (y @ h > 0)).reshape(3000, tables, planes).all(2).any(1)
    assert same.mean() > 0.999


def test_recall_over_tables_end_to_end(spark):
    """Links of a label with several tables and planes, and of small ones beside it."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(700):
        v = rng.standard_normal(24)
        for _ in range(rng.integers(1, 4)):
            rows.append((len(rows), v.tolist(), 1))
            v = v + rng.standard_normal(24) * 0.13
    rows += [(len(rows) + i, rows[i][1], 2) for i in range(30)]
    assert ed.tables_and_planes(1200, 0.93, 64, ed.RECALL)[0] > 10
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in ed.near_duplicate_embeddings(df, block=64).collect()}
    unit = ed._unit(np.array([r[1] for r in rows]))
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    want = near.sum(1)
    assert want.sum() > 800
    found = np.array([got[i][0] for i in range(len(rows))])
    assert (found <= want).all() and found.sum() >= 0.998 * want.sum()


def test_doubles_are_not_rounded(spark):
    tiny, huge = 1e-200, 1e200
    rows = [(1, [tiny, 2 * tiny], 0), (2, [huge, 2 * huge], 0), (3, [1.0, -0.5], 0), (4, [1e-45, 3e-45], 0)]
    # two vectors just below and above the threshold, which floats don't tell apart
    for k, c in ((5, 0.93 - 1e-12), (6, 0.93 + 1e-12)):
        rows.append((k, [c, float(np.sqrt(1 - c * c))], k))
        rows.append((k + 10, [1.0, 0.0], k))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in ed.near_duplicate_embeddings(df).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 2, 5: 0, 15: 0, 6: 1, 16: 1}


@pytest.mark.parametrize("n", [3, 700, 1500])
def test_windows_within_reach_lose_nothing(n):
    rng = np.random.default_rng(n)
    x = ed._unit(np.concatenate([rng.standard_normal((n, 12)), np.full((2, 12), 1.0)]) + 2)
    x = np.concatenate([x, ed._unit(x + rng.standard_normal(x.shape) * 0.02)])
    half, least = ed.window_and_count(0.93, ed.LINES, ed.RECALL)
    p = x @ ed._directions(12, ed.LINES, ed.SEED + 1)
    plain = {(i, j) for i, j in zip(*np.nonzero(sum((abs(line[:, None] - line) <= half).astype(int) for line in p.T) >= least)) if i < j}
    assert set(zip(*ed.candidate_pairs(p, half, least))) == plain
    close = {(i, j) for i, j in zip(*ed.candidate_pairs(p, half, least, ed._widest(x), half)) if x[i] @ x[j] >= 0.93}
    assert close == {(i, j) for i, j in plain if x[i] @ x[j] >= 0.93}
