import math

import numpy as np
import pytest

from factloom.llm import hard_negatives as h

LIMIT = (1 << 63) - 1


def brute(rows, positives=5, negatives=5, low_percent=80, high_percent=100):
    """Rows of the contract, by comparing each anchor with every row."""
    usable = [(i, r) for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]

    def score(a, b):
        return max(-LIMIT - 1, min(LIMIT, sum(int(x) * int(y) for x, y in zip(a, b))))

    found = []
    for i, (vec_id, label, v, anchor) in usable:
        if not anchor:
            continue
        others = sorted((-score(v, r[2]), r[0] is None, r[0] or 0, j) for j, r in usable if j != i and r[1] == label)
        unlike = sorted((-score(v, r[2]), r[0] is None, r[0] or 0, j) for j, r in usable if r[1] != label)
        for p, none, pid, _ in others[:positives]:
            inside = [n for n in unlike if low_percent * -p <= 100 * -n[0] <= high_percent * -p]
            for rank, n in enumerate(inside[:negatives], 1):
                found.append((vec_id, None if none else pid, rank, None if n[1] else n[2], -p, -n[0]))
    return sorted(map(str, found))


def sample(seed, n, dim=8, spread=40):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-150, 150, (12, dim))
    return [(i, int(rng.integers(0, 3)), [float(x) for x in centers[rng.integers(0, 12)] + rng.integers(-spread, spread, dim)], i % 9 == 0) for i in range(n)]


ODD = [
    (900, None, [1.0] * 8, True), (901, 1, None, True), (902, 1, [1.0, None] * 4, True), (903, 1, [float("nan")] * 8, False),
    (904, 1, [float("inf")] * 8, False), (905, 2, [], True), (906, 0, [5.0, 7.0], True), (907, 0, [0.0] * 8, True), (908, 0, [-0.0] * 8, True), (909, 7, [9.0] * 8, True),
]
SCHEMA = "vec_id long, label long, vector array<double>, is_anchor boolean, RANK int, away string, h1 int"


def check(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)
    got = h.mine_hard_negatives(df, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, **options)


def test_against_brute_force(spark):
    rows = sample(1, 300)
    # a hot vector, ties, repeated rows and ids, rows without an id or an anchor mark
    rows += [(1000 + i, i % 2, rows[0][2], i < 8) for i in range(120)] + [rows[9]] * 3 + [(None, 0, rows[0][2], True), (None, 1, rows[5][2], False), (9, 2, rows[7][2], None)] + ODD
    check(spark, rows)
    assert len(brute(rows)) > 300


@pytest.mark.parametrize("parts", [(16 * 64, 3), (1 << 20, 1 << 16)])
def test_parts_and_copies(spark, monkeypatch, parts):
    monkeypatch.setattr(h, "PART_BYTES", parts[0])
    monkeypatch.setattr(h, "MOST_VISITS", parts[1])
    monkeypatch.setattr(h, "MOST_LISTS", 5)
    check(spark, sample(2, 260), positives=2, negatives=7, low_percent=50, high_percent=120)


def test_numbers_beyond_doubles_and_longs(spark):
    rng = np.random.default_rng(5)
    big = [(i, i % 2, [float(x) for x in rng.integers(-(1 << 40), 1 << 40, 4)], i % 3 == 0) for i in range(60)]
    check(spark, big)
    check(spark, [(i, i % 2, [float((i % 5 + 1) * 10**12), float(i)], i < 9) for i in range(40)])


def test_no_rows_and_no_anchor(spark):
    for rows in ([], [(1, 1, [1.0], False)], [(1, 1, [1.0], True)], [(1, None, [1.0], True)]):
        check(spark, rows)


def test_bounds_hold_and_lists_are_skipped():
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 32)) * 200
    rows = np.floor(centers[rng.integers(0, 40, 4000)] + rng.standard_normal((4000, 32)) * 10)
    c = h.fit_centroids(rows[:1000], 40)
    near = h._distances(rows, c).argmin(1)
    used = np.unique(near)
    radii = np.array([np.sqrt(((rows[near == i] - c[i]) ** 2).sum(1)).max() for i in used])
    least, most = h.Lists(c[used], radii, np.ones(len(used), int)).bounds(rows[:50])
    exact = rows[:50] @ rows.T
    for k, i in enumerate(used):
        mine = exact[:, near == i]
        assert (least[:, k, None] <= mine).all() and (mine <= most[:, k, None]).all()
    kth = np.sort(exact, 1)[:, -6]
    assert (most >= kth[:, None]).mean() < 0.2
