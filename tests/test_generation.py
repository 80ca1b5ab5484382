"""Search rounds, end-to-end fits and maintained counts."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veiltab import TableSynthesizer
from veiltab.functions.hashing import hash_int, hash_long, uniform_of
from veiltab.operators import measure as ms
from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, linspace
from veiltab.operators.edits import Edits, expand_operators, mixed_weights, slots_of, to_state, update_weights
from veiltab.operators.marginals import Marginals, column_sets
from veiltab.operators.matching import deal, ranked, tree_edges
from veiltab.operators.modules import Chain, Covariance, NullCounts, SparseCounts
from veiltab.operators.rounds import ArrayRounds, TableRounds, in_arrays
from veiltab.operators.sampling import resample
from veiltab.plans.generator import Generator, should_stop
from veiltab.plans.synthesizer import fit_dp_adaptive, fit_zcdp
from veiltab.session import Workspace

DOMAIN = Domain(
    (
        Column("a", CATEGORICAL, 3), Column("b", CATEGORICAL, 2), Column("o", ORDINAL, 10, has_nulls=True),
        Column("x", CONTINUOUS, edges=linspace(0, 1, 17)),
    )
)


def table(spark, n=2000):
    """Four columns that hang together."""
    h = lambda s, k: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(k))
    a = F.when(h(1, 10) < 6, 0).when(h(1, 10) < 9, 1).otherwise(2)
    o = F.when(h(4, 20) > 0, F.least(a * 3 + h(2, 3), F.lit(9))).cast("long")
    return spark.range(n).select(
        a.cast("int").alias("a"), (h(3, 10) < 2 + 3 * a).cast("int").alias("b"), o.alias("o"),
        ((a * 3 + h(5, 100) / 30.0) / 10.0).alias("x"),
    )


def test_rounds_never_get_worse_and_reach_a_small_distance(spark):
    df = table(spark).persist()
    m = Marginals(DOMAIN, column_sets(DOMAIN, 2), 3)
    chain = Chain([m])
    targets = ms.measure_all(chain, df, 2000, 1e6, "s", "r")
    g = Generator(m, 2000, "s", rounds=12, stop_threshold=0.05, stop_window=3, min_rounds=5)
    fitted = g.fit(targets)
    history = [f for r, f in sorted({(r[0], r[1]) for r in fitted.log})]
    assert all(b <= a for a, b in zip(history, history[1:]))
    random = Generator(m, 2000, "s", rounds=0, from_tree=False).fit(targets).log[0][1]
    assert history[-1] <= 0.02 * random
    out = fitted.table.persist()
    assert out.count() == 2000 and out.select("row_id").distinct().count() == 2000
    assert out.where("a not in (0,1,2) or b not in (0,1) or o < 0 or o > 9 or x < 0 or x > 1").count() == 0
    # The running distance equals the distance recomputed from the rows.
    direct = ms.fitness(targets, chain.stats(out, 2000)).first()["fitness"]
    assert abs(direct - history[-1]) < 1e-9


def test_point_masses_are_matched_exactly(spark):
    """Two columns with few values among many bins: the search ends by its stop rule, at the target."""
    q = F.when(F.col("id") % 2 == 0, 0.61).when(F.col("id") % 10 == 1, 1.0).otherwise(0.05)
    df = spark.range(600).select(F.lit(0.29).alias("p"), q.alias("q"))
    meta = {n: {"type": "float", "lower": 0, "upper": 1} for n in ("p", "q")}
    s = TableSynthesizer(1e6, 1e-5, seed="point").fit(df, meta)
    assert s.fitted.converged and s.error().first()["max_error"] < 0.001
    assert s.fitted.log_frame(spark).where("converged").select("round").distinct().count() == 1


def test_lacking_cells(spark):
    m = Marginals(DOMAIN, [("a", "o"), ("b",), ("a", "b", "x")], 2)
    e = Edits(m, 10, ["fill"], "s")
    w = {(x.set_id, x.level): x for x in m.workloads}
    rows = [  # a=2, o=null bin; b=1; a=1, b=0, x in bin 5; a coarse cell and one with too many rows
        ((w[0, 0].workload_id << m.shift) + 2 * 11 + 10, 0.5), ((w[1, 0].workload_id << m.shift) + 1, 0.25),
        ((w[2, 0].workload_id << m.shift) + (1 * 2 + 0) * 16 + 5, 0.3), ((w[2, 1].workload_id << m.shift) + 1, 0.9), (3, -0.4),
    ]
    residuals = spark.createDataFrame(rows, "key long, r double")
    got = {(r["f1"], r["i1"], r["f2"], r["i2"]): r["lack"] for r in e.lacking_cells(residuals).collect()}
    third = 0.3 / 3
    assert got == {(0, 2, 2, 10): 0.5, (0, 1, 1, 0): third, (0, 1, 3, 5): third, (1, 0, 3, 5): third, (1, 1, -1, -1): 0.25}
    slots = e.lacking(residuals)
    assert slots.count == 10 and [r["slot"] for r in slots.table.orderBy("slot").collect()] == list(range(10))
    assert e.lacking(residuals.where("r < 0")).count == 0


def test_slots_of_many_cells_in_proportion(spark):
    """Thousands of cells in several buckets: every slot has one cell, and a cell its share of them to less than one."""
    cells = spark.range(5000).selectExpr("0 as f1", "cast(id as int) as i1", "-1 as f2", "-1 as i2", "1 + pmod(xxhash64(id), 1000) as w", "id as key")
    slots = slots_of(cells, ["key"], F.expr("cast(key / 700 as int)"), 12_345, 0.37)
    rows = slots.table.collect()
    assert sorted(r["slot"] for r in rows) == list(range(12_345))
    weight = {r["i1"]: r["w"] for r in cells.collect()}
    total, got = sum(weight.values()), {}
    for r in rows:
        got[r["i1"]] = got.get(r["i1"], 0) + 1
    assert all(abs(got.get(i, 0) - 12_345 * w / total) < 1 for i, w in weight.items())
    order = [r["i1"] for r in sorted(rows, key=lambda r: r["slot"])]
    assert order == sorted(order)


def offered(spark, *cells):
    frame = spark.createDataFrame([(*c, 1, i) for i, c in enumerate(cells)], "f1 int, i1 int, f2 int, i2 int, w long, key long")
    return slots_of(frame, ["key"], F.lit(0), 4 * len(cells), 0.5)


def test_guided_edits_without_given_edges(spark):
    """A continuous column on its default bins: the value lies in the bin that lacks rows."""
    d = Domain((Column("x", CONTINUOUS), Column("c", CATEGORICAL, 2)))
    m = Marginals(d, [("x", "c")], 3)
    rows = spark.range(40).select(F.col("id").alias("row_id"), F.lit(0.05).alias("x"), F.lit(0).alias("c"))
    e = Edits(m, 40, ["fill"], "s")
    p = e.propose(e.pairs(to_state(rows, d, 3), 1), 1, [1.0], e.grid({}), offered(spark, (0, 5, 1, 1)))
    assert p.where("c1 = 0 and y1 = 5 and x1 >= 5 / 7D and x1 < 6 / 7D and c2 = 1 and y2 = 1").count() == 40
    drawn = e.propose(e.pairs(to_state(rows, d, 3), 1), 1, [1.0], e.grid({}), offered(spark, (0, 0, -1, -1)))
    assert drawn.where("x1 is null or x1 >= 1 / 7D").count() == 0
    none = e.propose(e.pairs(to_state(rows, d, 3), 1), 1, [1.0], e.grid({}), None)
    assert none.where("c1 is not null").count() == 0 and none.count() == 40


def test_rows_are_dealt_evenly_over_slots(spark):
    """4,000 rows, 3,000 of them dealt out over 500 cells: none is crowded, none is left out."""
    d = Domain((Column("c", CATEGORICAL, 500),))
    m = Marginals(d, [("c",)], 1)
    rows = spark.range(4000).select(F.col("id").alias("row_id"), F.lit(0).alias("c"))
    e = Edits(m, 4000, ["fill"], "s")
    p = e.propose(e.pairs(to_state(rows, d, 1), 1), 1, [1.0], e.grid({}), offered(spark, *[(0, i, -1, -1) for i in range(500)]))
    got = [r["count"] for r in p.groupBy("y1").count().collect()]
    assert len(got) == 500 and min(got) >= 6 and max(got) <= 10


def test_quantiles_of_a_column_with_very_many_bins(spark):
    """8,192 bins are counted in runs of two; the quantiles still reach from end to end."""
    d = Domain((Column("x", CONTINUOUS, edges=linspace(0, 1, 8193)), Column("o", ORDINAL, 10_000)))
    df = spark.range(40_000).selectExpr("id as row_id", "(id + 0.5D) / 40000 as x", "id div 4 as o")
    e = Edits(Marginals(d, [("x",)], 1), 40_000, ["continuous"], "s")
    q = e.quantiles(to_state(df, d, 1))
    assert all(abs(v - k / 31) < 1e-3 for k, v in enumerate(q[0][1:-1]))
    assert all(abs(v - 10_000 * k / 31) < 4 for k, v in enumerate(q[1][1:-1]))


def test_quantiles_do_not_depend_on_partitions(spark):
    """Many rows, more than an approximate quantile holds exactly."""
    df = table(spark, 200_000).withColumn("row_id", F.monotonically_increasing_id())
    e = Edits(Marginals(DOMAIN, [("o", "x")], 3), 200_000, ["continuous"], "s")
    found = [e.quantiles(to_state(df.repartition(k), DOMAIN, 3)) for k in (2, 7, 16)]
    assert found[0] == found[1] == found[2]
    x = found[0][3]
    assert all(a <= b for a, b in zip(x, x[1:])) and max(found[0][2][1:-1]) <= 9.0


def test_systematic_resampling(spark):
    rows = spark.range(500).selectExpr("id as source", "id * 2 as x")
    for n in (2000, 500, 123, 1777):
        got = resample(rows, n, "seed", ["source"]).collect()
        assert sorted(r["row_id"] for r in got) == list(range(n))
        times = {}
        for r in got:
            times.setdefault(r["source"], set()).add(r["_copy"])
        assert {len(t) for t in times.values()} <= {n // 500, -(-n // 500)} and all(t == set(range(len(t))) for t in times.values())
    again = resample(rows.repartition(7), 1777, "seed", ["source"]).select("row_id", "source").collect()
    assert sorted(map(tuple, again)) == sorted((r["row_id"], r["source"]) for r in got)
    with pytest.raises(ValueError):
        resample(rows.limit(0), 10, "seed", ["source"])


@pytest.mark.parametrize("given", [500, 3000])
def test_a_start_table_of_another_size(spark, given):
    """It is resampled: the result has n_rows rows, and the distance is theirs."""
    df = table(spark, 2000).persist()
    m = Marginals(DOMAIN, column_sets(DOMAIN, 2), 3)
    targets = ms.measure_all(Chain([m]), df, 2000, 1e6, "s", "r")
    start = table(spark, given).withColumn("row_id", F.monotonically_increasing_id())
    fitted = Generator(m, 2000, "s", rounds=2).fit(targets, start)
    out = fitted.table.persist()
    assert out.count() == 2000 and sorted(r[0] for r in out.select("row_id").collect()) == list(range(2000))
    direct = ms.fitness(targets, Chain([m]).stats(out, 2000)).first()["fitness"]
    assert abs(direct - fitted.log[-1][1]) < 1e-9 and fitted.log[0][1] < 0.05


def test_dealt_counts(spark):
    """Every group meets its weights to less than one row; a group without weight has none."""
    rows = spark.range(3000).selectExpr("id as row_id", "cast(id % 3 as int) as part")
    cells = spark.createDataFrame([(0, c, 10 + c) for c in range(40)] + [(1, 7, 1)] + [(2, 5, 0)], "g int, c int, w long")
    got = deal(ranked(rows, "part", 3000, "s", "t"), cells, "bin").collect()
    assert len(got) == 3000
    counts = {}
    for r in got:
        counts[r["part"], r["bin"]] = counts.get((r["part"], r["bin"]), 0) + 1
    total = sum(10 + c for c in range(40))
    assert all(abs(counts[0, c] - 1000 * (10 + c) / total) < 1 for c in range(40))
    assert counts[1, 7] == 1000 and counts[2, None] == 1000


def test_tree_of_most_information():
    pairs = [(0.5, 0, 0, 1), (0.9, 1, 1, 2), (0.7, 2, 0, 2), (0.2, 3, 3, 4)]
    assert tree_edges(pairs, 6) == [(None, 0, 2), (0, 2, 2), (2, 1, 1), (None, 3, 3), (3, 4, 3), (None, 5, -1)]


def test_start_table_along_the_tree(spark):
    """Pairs on the tree are met at once, and the search starts far below a random table."""
    df = table(spark, 4000).persist()
    m = Marginals(DOMAIN, column_sets(DOMAIN, 2), 3)
    chain = Chain([m])
    targets = ms.measure_all(chain, df, 4000, 1e6, "s", "r").persist()
    tree = Generator(m, 4000, "s", rounds=0).fit(targets)
    free = Generator(m, 4000, "s", rounds=0, from_tree=False).fit(targets)
    assert tree.log[0][1] < 0.15 * free.log[0][1]
    out = tree.table.persist()
    assert out.count() == 4000 and out.where("a not in (0,1,2) or o < 0 or o > 9 or x < 0 or x > 1").count() == 0
    direct = ms.fitness(targets, chain.stats(out, 4000)).first()["fitness"]
    assert abs(direct - tree.log[-1][1]) < 1e-9


def test_finer_and_finer_rows(spark):
    """Few rows that stand for many, then more: the distance is the one of the rows at the end."""
    df = table(spark, 6000).persist()
    m = Marginals(DOMAIN, column_sets(DOMAIN, 2), 3)
    chain = Chain([m])
    targets = ms.measure_all(chain, df, 6000, 1e6, "s", "r").persist()
    g = Generator(m, 6001, "s", rounds=7, first_rows=500, finer=3, from_tree=False, finer_below=0.9)
    assert g.sizes() == [666, 2000, 6001]
    fitted = g.fit(targets)
    out = fitted.table.persist()
    assert out.count() == 6001 and out.select("row_id").distinct().count() == 6001
    sizes = [r[8] for r in fitted.log]
    assert sizes == sorted(sizes) and len({*sizes}) > 1
    state = to_state(out, DOMAIN, 3)
    assert state.where("exists(b, x -> x < 0)").count() == 0
    if fitted.log[-1][8] == 6001:
        direct = ms.fitness(targets, chain.stats(out, 6001)).first()["fitness"]
        assert abs(direct - fitted.log[-1][1]) < 1e-9


MIXED = Domain(
    (
        Column("a", CATEGORICAL, 3), Column("o", ORDINAL, 10, has_nulls=True),
        Column("x", CONTINUOUS, edges=linspace(0, 1, 9), sparse=True),
    )
)
MOMENTS = {"o": {"mean": 4.0, "std": 2.5}, "x": {"mean": 0.3, "std": 0.25}}


def mixed_chain(sets=(("a", "o"),), depth=1):
    m = Marginals(MIXED, list(sets), depth)
    return m, Chain([m, Covariance(MIXED, MOMENTS, 16), NullCounts(MIXED), SparseCounts(MIXED)])


def mixed_rows(spark, n):
    """A fifth of o is NULL, three tenths of x are 0, and the two hang together."""
    h = lambda s, k: F.pmod(F.xxhash64("id", F.lit(s)), F.lit(k))
    o = F.when(h(1, 5) > 0, h(2, 10)).cast("long")
    x = F.when(h(3, 10) < 3, 0.0).otherwise(F.coalesce("o", F.lit(5)) / 20.0 + h(4, 100) / 200.0)
    return spark.range(n).select("id", h(5, 3).cast("int").alias("a"), o.alias("o")).withColumn("x", x).drop("id")


def test_scores_of_other_modules_equal_a_recount(spark):
    n, (m, chain) = 60, mixed_chain()
    targets = ms.measure_all(chain, mixed_rows(spark, 500), 500, 1e6, "s", "r")
    g = Generator(m, n, "s").matching(chain)
    table = mixed_rows(spark, n).withColumn("row_id", F.monotonically_increasing_id())
    table = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(table.collect())], "row_id long, a int, o long, x double")
    e = Edits(g.targets, n, ["mutate", "swap"], "s", candidates=6)
    state = to_state(table, MIXED, 1)
    res = g.residuals(targets, table)
    p = e.propose(e.pairs(state, 1), 1, [0.8, 0.2], e.grid({}))
    scored = e.score(p, e.potentials(g.targets.cell_map(spark), res)).collect()
    rows = {r["row_id"]: list(r["v"]) for r in state.collect()}
    side = {(r["pair_id"], r["side"]): r["row_id"] for r in p.select("pair_id", "side", "row_id").distinct().collect()}
    want = {(r["module"], r["workload_id"], r["cell"]): r["noised"] for r in targets.collect()}
    edges = linspace(-2, 2, 16)

    def cells(v):
        a, o, x = v
        yield "marginals", 0, int(a * 11 + (10 if o is None else o))
        if o is None:
            yield "null_counts", 1, 0
        if x is None:
            yield "null_counts", 2, 0
        if abs(x) < 1e-9:
            yield "sparse_counts", 0, 0
        if o is not None:
            b = sum(y <= (x - 0.3) / 0.25 * ((o - 4.0) / 2.5) for y in edges) - 1
            if 0 <= b < 15:
                yield "covariance", 0, b

    def distance(table):
        left = dict(want)
        for v in table.values():
            for c in cells(v):
                left[c] -= 1 / n
        return sum(r * r for r in left.values())

    now, tried = distance(rows), 0
    for r in scored:
        if r["op"] == 0:
            row = side[r["pair_id"], r["side"]]
            v = list(rows[row])
            v[r["c1"]] = r["x1"]
            assert abs(distance({**rows, row: v}) - now - r["change"]) < 1e-12
            tried += 1
        elif r["op"] == 1 and r["side"] == 0:
            one, two = side[r["pair_id"], 0], side[r["pair_id"], 1]
            v, w, c = list(rows[one]), list(rows[two]), r["c1"]
            v[c], w[c] = w[c], v[c]
            assert abs(distance({**rows, one: v, two: w}) - now - r["change"]) < 8 / n**2
            tried += 1
    assert tried > 200


def test_all_modules_of_a_chain_are_matched(spark):
    n, (m, chain) = 800, mixed_chain([("a", "o"), ("a", "x")], 2)
    df = mixed_rows(spark, n).persist()
    g = Generator(m, n, "s", rounds=8)
    fitted, targets = fit_zcdp(g, chain, df, n, 1e6)
    out = fitted.table.persist()
    history = [f for _, f in sorted({(r[0], r[1]) for r in fitted.log})]
    assert all(b <= a for a, b in zip(history, history[1:]))
    assert abs(ms.fitness(targets, chain.stats(out, n)).first()["fitness"] - history[-1]) < 1e-9
    start = g.start_table(spark)
    for name in chain.modules:
        own = targets.where(F.col("module") == name)
        was, now = (ms.fitness(own, chain.stats(t, n)).first()["fitness"] for t in (start, out))
        assert now <= 0.1 * was, name
    assert out.where("a is null or x is null or x < 0 or x > 1").count() == 0
    # a measurement nobody matches is an error, not a fit that ignores it
    with pytest.raises(ValueError, match="covariance"):
        g.fit(targets.where("module = 'covariance'"))


def test_nulls_need_a_null_bin(spark):
    df = spark.createDataFrame([("u", 1.0)] * 30 + [(None, 2.0)] * 30, "c string, x double")
    meta = {"c": {"type": "string"}, "x": {"type": "float", "lower": 0, "upper": 4}}
    with pytest.raises(ValueError, match="NULLs"):
        TableSynthesizer(1e4, 1e-5, seed="n").fit(df, meta, rounds=1)
    s = TableSynthesizer(1e4, 1e-5, seed="n").fit(df, meta, rounds=1, nullable=True)
    assert [c.has_nulls for c in s.domain.columns] == [True, False]
    assert abs(s.measurement.where("workload_id = 0").agg(F.sum("noised")).first()[0] - 1) < 0.05
    s.close()


def test_inferred_roles_bring_nullability(spark):
    df = spark.createDataFrame([("u", "a")] * 20 + [(None, "b")] * 20, "c string, d string")
    s = TableSynthesizer(1e4, 1e-5, seed="n").fit(df, rounds=1)
    assert [c.has_nulls for c in s.domain.columns] == [True, False]


def test_adaptive_rounds_keep_a_ledger_and_reports(spark):
    df = table(spark, 500).persist()
    m = Marginals(DOMAIN, column_sets(DOMAIN, 2), 1)
    g = Generator(m, 500, "s", rounds=2)
    reports = []
    fitted, _ = fit_dp_adaptive(g, Chain([m]), df, 500, 2, 1e3, 1e-6, k=1, reports=reports)
    assert len(reports) == 2 and fitted.ledger.spent <= fitted.ledger.rho * (1 + 1e-9)
    assert [e[0] for e in fitted.ledger.entries] == ["select", "measure"] * 2
    fitted, _ = fit_zcdp(g, Chain([m]), df, 500, 10.0)
    assert fitted.ledger.spent == 10.0


def test_same_seed_same_table(spark):
    df = table(spark, 300)
    m = Marginals(DOMAIN, column_sets(DOMAIN, 2), 2)
    targets = ms.measure_all(Chain([m]), df, 300, 1e4, "s", "r").persist()
    runs = []
    for parts in ("8", "3"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            runs.append(sorted(map(repr, Generator(m, 300, "s", rounds=2).fit(targets).table.collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1]


def test_operator_weights():
    assert expand_operators(("mutate", "continuous", "swap", "cross"), DOMAIN) == [
        "mutate", "fill", "continuous", "swap", "cross1", "cross2"
    ]
    only = Domain((Column("x", CONTINUOUS),))
    assert expand_operators(("mutate", "continuous", "cross"), only) == ["mutate", "fill", "continuous"]
    w = update_weights([0.5, 0.5], [1.0, 0.0])
    assert w[0] > w[1] and abs(sum(w) - 1) < 1e-12
    assert abs(sum(mixed_weights(w)) - 1) < 1e-12 and min(mixed_weights([1.0, 0.0])) == 0.025


def test_early_stop_rule():
    assert not should_stop([1.0, 0.5], 0.1, 5, 5)
    assert should_stop([1.0] * 8, 0.1, 2, 3)
    assert not should_stop([1.0 / 2**i for i in range(8)], 0.1, 2, 3)


def test_one_column_table(spark):
    df = spark.range(200).select((F.col("id") % 4).cast("string").alias("c"))
    s = TableSynthesizer(1e4, 1e-5, seed="t").fit(df, {"c": {"type": "string"}}, rounds=8)
    assert s.marginals.sets == [("c",)]
    assert s.sample().groupBy("c").count().count() == 4
    assert s.error().first()["max_error"] < 0.05


def test_end_to_end_budget_and_columns(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 3 == 0, "u").otherwise("v").alias("c"),
        (F.col("id") % 200 + 10).cast("int").alias("o"),
        (F.col("id") % 40 / 4.0).alias("x"),
    )
    meta = {"c": {"type": "string"}, "o": {"type": "int", "lower": 10, "upper": 209}, "x": {"type": "float"}}
    with pytest.raises(ValueError):
        TableSynthesizer(1.0, 1e-6).fit(df, meta)
    s = TableSynthesizer(1e4, 1e-5, seed="t").fit(df, meta, preprocessor_eps=10.0, rounds=3, n_rows=300)
    assert s.ledger.spent <= s.rho * (1 + 1e-9)
    steps = {r["step"] for r in s.ledger.frame(spark).collect()}
    assert steps == {"edges", "marginals", "preprocess"}
    out = s.sample()
    assert out.columns == ["c", "o", "x"] and out.count() == 300
    assert {r["c"] for r in out.select("c").distinct().collect()} <= {"u", "v"}
    assert out.agg(F.min("o"), F.max("o")).first()[0] >= 10
    assert s.sample(750).count() == 750 and s.sample(100).count() == 100


def test_stream_of_changes_equals_recount(spark, sf, tmp_path):
    """Rows arrive and leave in micro-batches; a repeated batch changes nothing."""
    from veiltab.plans.queries_stats import PAIRS
    from veiltab.plans.queries_tables import encoded_line
    from veiltab.streaming.changes import MaintainedCounts

    e = encoded_line(spark, sf)
    start, leave, come = e.where("l_linenumber < 3"), e.where("l_linenumber = 0"), e.where("l_linenumber >= 3")
    changes = come.withColumn("removed", F.lit(False)).unionByName(leave.withColumn("removed", F.lit(True)))
    changes.repartition(3).write.parquet(str(tmp_path / "in"))
    kept = MaintainedCounts(PAIRS.counts(start), PAIRS, str(tmp_path / "counts"))
    q = (
        spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        .writeStream.foreachBatch(kept).option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    kept(changes, 0)
    want = PAIRS.counts(e.where("l_linenumber > 0"))
    assert kept.counts.exceptAll(want).count() == 0 and want.exceptAll(kept.counts).count() == 0
    # a new object on the same path, as after a restart: it goes on, and old batches are skipped
    again = MaintainedCounts(PAIRS.counts(start), PAIRS, str(tmp_path / "counts"))
    assert again.last_batch == kept.last_batch > 0
    again(changes, kept.last_batch)
    assert again.counts.exceptAll(want).count() == 0 and want.exceptAll(again.counts).count() == 0
    again(changes.where("removed").withColumn("removed", F.lit(False)), kept.last_batch + 1)
    more = PAIRS.counts(e)
    assert again.counts.exceptAll(more).count() == 0 and more.exceptAll(again.counts).count() == 0
    assert len(again._done()) <= MaintainedCounts.KEEP + 1


def test_product_histograms_of_forty_columns(spark, capsys):
    rng = np.random.default_rng(5)
    names = [f"c{i}" for i in range(40)]
    x = rng.random((300, 40))
    df = spark.createDataFrame(pd.DataFrame(x, columns=names))
    df = df.withColumn("c3", F.when(F.col("c3") > 0.1, F.col("c3")))  # a product with NULL is in no cell
    x[:, 3] = np.where(x[:, 3] > 0.1, x[:, 3], np.nan)
    domain = Domain(tuple(Column(n, CONTINUOUS) for n in names))
    moments = {n: {"mean": 0.5, "std": 0.25} for n in names}
    module = Covariance(domain, moments, 16)
    counts = module.counts(df)
    got = {(r["workload_id"], r["cell"]): r["cnt"] for r in counts.collect()}
    want = {}
    z, edges = (x - 0.5) / 0.25, np.array(module.edges)
    for p, (a, b) in enumerate(module.pairs):
        prod = z[:, names.index(a)] * z[:, names.index(b)]
        cell = np.searchsorted(edges, prod[~np.isnan(prod)], "right") - 1
        for c, n in zip(*np.unique(cell[(cell >= 0) & (cell < 15)], return_counts=True)):
            want[p, int(c)] = int(n)
    assert module.n_workloads == 780 and got == want
    module.counts(df).explain("formatted")
    assert len(re.findall(r"\n\(\d+\) Exchange", capsys.readouterr().out)) == 1  # no side that is joined
    assert module.counts(df, [7]).select("workload_id").distinct().collect() == [(7,)]
    assert module.counts(df, []).count() == 0


@pytest.mark.parametrize("candidates", [1, 4])
def test_a_round_in_one_pass_equals_joins(spark, monkeypatch, candidates):
    """Swaps, guided edits, null bins, zeros, modules, rows without a partner and odd bins among them."""
    n, (m, chain) = 61, mixed_chain([("a", "o"), ("o", "x"), ("a", "x")], 3)
    targets = ms.measure_all(chain, mixed_rows(spark, 500), 500, 1e6, "s", "r")
    g = Generator(m, n, "s").matching(chain)
    rows = [(i, *r) for i, r in enumerate(mixed_rows(spark, n).collect())]
    for i in range(5, 25):
        rows[i] = (i, None, *rows[i][2:])  # NULL in a column without a null bin
    table = spark.createDataFrame(rows, "row_id long, a int, o long, x double")
    e = Edits(g.targets, n, ["mutate", "fill", "continuous", "swap", "cross1"], "s", candidates=candidates)
    state, res = to_state(table, MIXED, 3), g.residuals(targets, table)
    pairs, weights = e.pairs(state, 1), [0.2, 0.2, 0.2, 0.3, 0.1]
    args = pairs, 1, weights, e.quantiles(state), e.lacking(res, 1), e.potentials(g.targets.cell_map(spark), res)

    def result():
        got = e.best(*args).collect()
        return sorted((r["row_id"], *(r[c] for c in ("v", "b", "cand", "op", "c1", "c2", "x1", "x2", "y1", "y2", "change"))) for r in got)

    one = result()
    assert "Join" not in e.best(*args[:4], None, args[5])._jdf.queryExecution().executedPlan().toString()  # before: a round was two joins and two windows
    monkeypatch.setattr("veiltab.session.BROADCAST_BYTES", 0)
    joined = result()
    assert len(one) == n * (candidates == 4 or 1) and len({r[4] for r in one}) > 3
    for a, b in zip(one, joined):
        assert a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-14


def test_numpy_hashes_equal_sparks(spark):
    keys = [0, 1, -1, 7, 1 << 40, -(1 << 62), (1 << 63) - 1]
    df = spark.createDataFrame([(k, c) for k in keys for c in (0, 1, 5)], "k long, c int")
    rows = df.selectExpr("k", "c", "xxhash64('s|r|1') as s", "xxhash64('s|r|1', k, c) as h").selectExpr(
        "*", "xxhash64(h, 3) as d", "(shiftrightunsigned(xxhash64(h, 3), 12) + 0.5D) / 4503599627370496D as u"
    )
    k, c, s, h, d, u = (np.array(x) for x in zip(*rows.collect()))
    assert (hash_int(c, hash_long(k, s)) == h).all()
    own = hash_int(np.int64(3), hash_long(h, np.int64(42)))
    assert (own == d).all() and (uniform_of(own) == u).all()


@pytest.mark.parametrize("n", [700, 701])  # all rows paired, and one alone
def test_rounds_over_arrays_equal_rounds_over_tables(spark, n):
    """Same edits, sets, counts and rows in each of three rounds, with NULLs and other modules."""
    d = Domain(tuple(Column(c.name, c.role, c.size, c.edges, has_nulls=c.name == "o") for c in DOMAIN.columns))
    m = Marginals(d, column_sets(d, 2), 3)
    df = table(spark, n)
    moments = {"o": {"mean": 3.0, "std": 2.5}, "x": {"mean": 0.4, "std": 0.3}}
    chain = Chain([m, Covariance(d, moments), NullCounts(d)])
    g = Generator(m, n, "s").matching(chain)
    targets = ms.measure_all(chain, df, n, 1e4, "s", "r")
    start = g.start_table(spark, 0.1)
    state = to_state(start, d, 3).persist()
    ops = expand_operators(g.operators, d)
    edits = Edits(g.targets, n, ops, "s", "run", 4)
    assert in_arrays(edits)
    res, cells = g.residuals(targets, start), g.targets.cell_map(spark)
    work = Workspace(spark, "both")
    one, two = ArrayRounds(edits, state, res, work), TableRounds(edits, state, res, cells, Workspace(spark, "other"))
    a = b = state
    weights = [1.0 / len(ops)] * len(ops)
    for k in (1, 2, 3):
        (a, pick, tally), (b, *other) = one.step(a, k, weights), two.step(b, k, weights)
        assert [pick, tally] == other and pick is not None
        assert abs(one.distance - two.distance) < 1e-9
        assert edits.quantiles(a) == edits.quantiles_of(one.counts) == two.quantiles
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    assert "merged" not in work._turn  # before: every round joined and wrote the residuals of all cells
