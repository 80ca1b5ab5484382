"""Edges, levels and bins: exact partitions, closed at the top, never mutated."""

import math
import random

import pytest
from pyspark.sql import functions as F

from veiltab.functions.bins import add_bins, bin_table
from veiltab.operators import histograms as hist
from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, linspace
from veiltab.operators.marginals import Marginals, box_queries, column_sets


@pytest.mark.parametrize(
    "n_edges,level,stride,bins",
    [(2, 0, 1, 1), (2, 1, 1, 1), (3, 0, 1, 2), (3, 1, 1, 2), (4, 1, 2, 1), (5, 1, 2, 2), (8, 0, 1, 7),
     (8, 1, 2, 3), (8, 2, 4, 1), (64, 0, 1, 63), (64, 1, 2, 31), (64, 2, 4, 15)],
)
def test_level_strides(n_edges, level, stride, bins):
    c = Column("x", CONTINUOUS, edges=linspace(0, 1, n_edges))
    assert c.coarse(3, level) == (stride, bins)


def test_top_value_is_counted(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    got = [r["b"] for r in add_bins(df, {"b": ("x", list(linspace(0, 1, 5)))}).orderBy("x").collect()]
    assert got == [None, 0, 2, 3]


def test_every_workload_is_a_partition(spark):
    """64 edges on two columns: each row falls in exactly one cell on every level."""
    d = Domain((Column("x", CONTINUOUS, edges=linspace(0, 1, 64)), Column("y", CONTINUOUS, edges=linspace(0, 1, 64))))
    u = lambda s: (F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1001)) / 1000.0)
    df = spark.range(500).select(u(1).alias("x"), u(2).alias("y"))
    m = Marginals(d, column_sets(d, 2), 3)
    sums = m.counts(df).groupBy("workload_id").agg(F.sum("cnt").alias("n")).collect()
    assert sorted((r["workload_id"], r["n"]) for r in sums) == [(0, 500), (1, 500), (2, 500)]
    assert d["x"].edges == linspace(0, 1, 64)


def test_coarse_counts_equal_direct_counts(spark):
    """Rolling up equals binning by the coarse boxes themselves."""
    e = linspace(0, 1, 64)
    d = Domain((Column("x", CONTINUOUS, edges=e), Column("c", CATEGORICAL, 3)))
    df = spark.range(400).select((F.pmod(F.xxhash64("id"), F.lit(997)) / 996.0).alias("x"),
                                 F.pmod("id", F.lit(3)).cast("int").alias("c"))
    m = Marginals(d, [("x", "c")], 3)
    rows = [(r["x"], r["c"]) for r in df.collect()]
    boxes = {}
    for b in m.boxes(spark).collect():
        boxes.setdefault((b["workload_id"], b["dim"]), {})[b["bin"]] = (b["lo"], b["hi"])
    for w in m.workloads:
        got = {r["cell"]: r["cnt"] for r in m.counts(df).where(f"workload_id = {w.workload_id}").collect()}
        want = {}
        for x, c in rows:
            (bx,) = [b for b, (lo, hi) in boxes[w.workload_id, 1].items() if lo <= x < hi or (x == 1.0 and hi == 1.0)]
            cell = bx * 3 + c
            want[cell] = want.get(cell, 0) + 1
        assert got == want


def test_many_sets_use_positions(spark, monkeypatch):
    from veiltab.operators import marginals as mg

    cols = [Column(f"c{i}", CATEGORICAL, 2 + i % 3) for i in range(6)]
    d = Domain(tuple(cols))
    df = spark.range(300).select(*[F.pmod(F.xxhash64("id", F.lit(c.name)), F.lit(c.size)).cast("int").alias(c.name) for c in cols])
    m = Marginals(d, column_sets(d, 3), 1)
    plain = sorted(map(tuple, m.counts(df).collect()))
    monkeypatch.setattr(mg, "WIDE_SETS", 2)
    assert sorted(map(tuple, m.counts(df).collect())) == plain


def test_missing_value_without_null_bin_is_in_no_cell(spark):
    d = Domain((Column("x", CONTINUOUS), Column("c", CATEGORICAL, 2)))
    df = spark.createDataFrame([(0.1, 0), (None, 1)], "x double, c int")
    assert Marginals(d, [("x", "c")], 1).counts(df).agg(F.sum("cnt")).first()[0] == 1


def test_all_null_and_single_value_columns(spark):
    d = Domain((Column("x", CONTINUOUS, has_nulls=True), Column("o", ORDINAL, 1)))
    df = spark.createDataFrame([(None, 0)] * 5, "x double, o long")
    b = bin_table(df, d, 3).first()
    assert (b["b_x"], b["b_o"]) == (7, 0)


def test_adaptive_edges_follow_the_data(spark):
    """Half of the values in one narrow place: half of the edges go there."""
    df = spark.range(4000).select(
        F.when(F.col("id") < 2000, F.lit(0.3001)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("x")
    )
    d = Domain((Column("x", CONTINUOUS),))
    e = hist.private_edges(df, d, ["x"], 4000, 1e6, 16, 0.001, "t")["x"]
    assert len(e) == 16 and e == sorted(set(e))
    assert sum(0.29 < x < 0.31 for x in e) >= 7


def test_tree_height_is_at_least_one():
    assert hist.tree_height(Column("x", CONTINUOUS), 4096, 0.001) == 1
    assert hist.tree_height(Column("o", ORDINAL, 100123), 64, 1.0) == int(math.log2(100123 / 64) + 1)


def test_exact_quantiles_over_many_buckets(spark, monkeypatch):
    import numpy as np

    values = [((i * 7919) % 5003) / 7.0 for i in range(3000)] + [5.0] * 1500
    df = spark.createDataFrame([(v,) for v in values], "x double")
    monkeypatch.setattr(hist, "bucket_count", lambda rows: 37)
    got = {r["i"]: r["value"] for r in hist.exact_quantiles(df, ["x"], [0.0, 0.1, 0.5, 0.77, 1.0]).collect()}
    want = np.quantile(values, [0.0, 0.1, 0.5, 0.77, 1.0])
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))


def test_private_bounds_contain_the_bulk(spark):
    df = spark.range(5000).select((F.col("id") % 900 + 100).cast("double").alias("x"))
    r = hist.private_bounds(df, ["x"], 1.0, "t").first()
    assert (r["lower"], r["upper"]) == (64.0, 1024.0)


@pytest.mark.parametrize("height, q, noise", [(1, 4, 0.0), (4, 5, 0.0), (6, 16, 0.02), (7, 9, 0.2)])
def test_tree_cuts_equal_a_walk_over_the_edges(spark, height, q, noise):
    """Also where noise makes the mass fall from one edge to the next."""
    rng = random.Random(height)
    leaves = [rng.random() ** 3 for _ in range(2**height)]
    leaves = [x / sum(leaves) for x in leaves]
    stats = []
    for level in range(height):
        width = 2 ** (height - 1 - level)
        for b in range(2 ** (level + 1)):
            stats.append((level, b, sum(leaves[b * width : (b + 1) * width]) + rng.gauss(0, noise)))
    stat = {(level, b): x for level, b, x in stats}
    bits = [[((i >> (height - 1 - level)), level) for level in range(height)] for i in range(2**height)]
    mass = [sum(stat[level, up - 1] for up, level in row if up % 2) for row in bits]
    cuts, i = [0], 0
    while (i := next((j for j in range(i + 1, 2**height - 1) if mass[j + 1] > mass[cuts[-1]] + 1 / q), None)) is not None:
        cuts.append(i)
    got = hist.tree_quantiles(spark.createDataFrame(stats, "level int, bin long, stat double"), 3.0, height, q).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(len(cuts)))
    assert [r["edge"] for r in got] == [c * 3.0 / 2**height for c in cuts]


def test_boxes_of_several_sets_in_one_scan(spark):
    rng = random.Random(3)
    cell = lambda: rng.choice([None, 0.0, 1.0, *(rng.random() for _ in range(5))])
    rows = [(cell(), cell(), cell()) for _ in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    at = {"x": 0, "y": 1, "z": 2}
    boxes = []
    for q in range(1000):
        cols = rng.choice([("x",), ("y", "x"), ("x", "y", "z"), ("z", "y")])
        boxes.append((q, {c: (round(rng.uniform(-0.2, 1), 2), round(rng.uniform(0, 1.2), 2)) for c in cols}))
    got = box_queries(df, boxes, len(rows))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    found = {r["query_id"]: r["stat"] for r in got.collect()}
    for q, box in boxes:
        n = sum(all(r[at[c]] is not None and lo <= r[at[c]] < hi for c, (lo, hi) in box.items()) for r in rows)
        assert math.isclose(found[q], n / len(rows))
    assert box_queries(df, [], 300).collect() == []
