"""Operator 12 against all scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veiltab.llm import hard_negatives as hn


def plain(rows, step, low=80, n=5):
    """rows: (id, vector, label); anchors: ids divisible by step."""
    width = max((len(v) for _, v, _ in rows if v is not None), default=0)
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    vectors = [np.array([*v, *[0] * (width - len(v))]) for _, v, _ in rows]
    out = []
    for a, (own, _, label) in enumerate(rows):
        if own % step:
            continue
        scored = sorted((-int(vectors[a] @ vectors[b]), rows[b][0], b) for b in range(len(rows)) if b != a)
        for s, positive, _ in [x for x in scored if rows[x[2]][2] == label][:n]:
            fits = [x for x in scored if rows[x[2]][2] != label and low * -s <= 100 * -x[0] <= 100 * -s]
            out += [(own, positive, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits[:n])]
    return sorted(out)


def mined(spark, rows, step, **kw):
    rows = [(k, None if v is None else [None if x is None else float(x) for x in v], c, "x", 1) for k, v, c in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string, row int")
    return sorted(tuple(r) for r in hn.mine(df, F.col("vec_id") % step == 0, **kw).collect())


def cloud(n, width, seed, spread=40):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-100, 100, (6, width))
    return [(k, (centres[k % 6] + rng.integers(-spread, spread, width)).tolist(), k % 4) for k in range(n)]


def test_spanning_tree_is_the_smallest():
    vectors = np.random.default_rng(0).normal(size=(40, 5))
    order, parent, edge = hn.spanning_tree(vectors)
    assert sorted(order.tolist()) == list(range(40)) and all(p < k for k, p in enumerate(parent.tolist()))
    at = vectors[order]
    assert np.allclose(edge[1:], [np.linalg.norm(at[k] - at[p]) for k, p in enumerate(parent.tolist()) if p >= 0])
    full = ((vectors[:, None] - vectors[None]) ** 2).sum(-1) ** 0.5
    joined, total = {0}, 0.0
    while len(joined) < 40:
        w, b = min((full[a, b], b) for a in joined for b in range(40) if b not in joined)
        joined.add(b)
        total += w
    assert np.isclose(edge.sum(), total)


def test_bounds_hold_and_spare_most_scores():
    """Anchors near each other: exact scores lie within the bounds, and few rows are scored again."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (8, 32))
    rows = (centres[rng.integers(0, 8, 4000)] + rng.integers(-4, 5, (4000, 32))).astype(float)
    order, parent, edge = hn.spanning_tree(rows[:64])
    anchors = rows[:64][order]
    scores = hn.Scores(rows, anchors, parent, edge)
    ids = np.arange(4000)
    for k in range(64):
        exact = rows @ anchors[k]
        (pick, score), = hn.negatives_of(scores, k, np.ones(4000, bool), [(0.9 * exact.max(), exact.max())], ids, ids, 5)
        assert score.tolist() == np.sort(exact)[::-1][:5].tolist()
        if k in scores.open:
            low, high = scores.open[k]
            assert (low <= exact).all() and (exact <= high).all()
    assert scores.scored < 0.5 * 64 * 4000


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_all_scores(spark, monkeypatch, seed):
    monkeypatch.setattr(hn, "BLOCK", 16)
    monkeypatch.setattr(hn, "SENT_BYTES", 4096)
    rows = cloud(600, 8, seed)
    assert mined(spark, rows, 10) == plain(rows, 10)


def test_ties_nulls_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [k % 3, 1.0, 2.0], k % 2) for k in range(60)]  # many ties
    rows += [(7, [1.0, 1.0, 2.0], 0), (7, [1.0, 1.0, 2.0], 0), (100, [1.0, 0.0, 0.0], 0), (100, [1.0, 0.0, 0.0], 0)]  # repeated rows
    rows += [(20, None, 1), (30, [1.0, None], 1), (40, [nan, 1.0], 1), (50, [1.0, inf], 0), (None, [1.0], 0), (70, [1.0, 2.0], None)]
    rows += [(80, [], 0), (90, [5.0], 1), (110, [-9.0, -9.0, -9.0], 3)]
    assert mined(spark, rows, 10) == plain(rows, 10)
    assert mined(spark, [], 10) == [] and mined(spark, [(1, [1.0], 0)], 10) == []
    assert mined(spark, [(10, [1.0], 0), (20, [2.0], 0)], 10) == []  # one label


def test_a_label_with_a_third_of_the_rows(spark):
    random.seed(3)
    rows = [(k, [random.randint(-9, 9) for _ in range(4)], 0 if k % 3 == 0 else k % 7) for k in range(900)]
    assert mined(spark, rows, 50) == plain(rows, 50)


def test_products_beyond_exactness_are_refused(spark):
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e9], 0), (1, [1.0], 1)], 10)
