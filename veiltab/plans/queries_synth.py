"""Synthetic tables: random start, edits, rounds, end-to-end fits and evaluation."""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform_sql
from veiltab.functions.literals import array_lit, small_table
from veiltab.functions.ranking import bucket_count, with_position
from veiltab.operators import encode as enc
from veiltab.operators import evaluate as ev
from veiltab.operators import marginals as mg
from veiltab.operators import measure as ms
from veiltab.operators import sampling as smp
from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL, linspace
from veiltab.operators.edits import (
    COPY1, COPY2, FILL, MUTATE, QUANTILE, QUANTILE_POINTS, SWAP, Edits, slots_of, to_state, update_weights,
)
from veiltab.operators.histograms import quantile_grid
from veiltab.operators.modules import Chain, Covariance, NullCounts
from veiltab.operators.random_table import random_table
from veiltab.operators.rounds import SINGLY
from veiltab.operators.sampling import resample
from veiltab.plans import oracle as sql
from veiltab.plans.generator import Generator, should_stop
from veiltab.plans.queries_private import (
    CHAIN, DENSE, EACH, FINE, N, OTHER, PAIRS, RHO, RUN, both,
)
from veiltab.plans.queries_stats import COV_COLS, COV_SQL, DEPTH, line_moments
from veiltab.plans.queries_tables import LINE, LINE_KEY, SEED, encoded_line, largest
from veiltab.plans.registry import query, table
from veiltab.plans.synthesizer import TableSynthesizer, fit_dp_adaptive, fit_zcdp
from veiltab.session import Workspace

KEYS_SQL = ", ".join(LINE_KEY)
NAMES = FINE.names


def current_table(spark, sf):
    """lineitem, encoded, with dense row ids: a table in the role of the current synthetic one."""
    t = table(spark, sf, "lineitem")
    rows = t.count()
    buckets = bucket_count(rows)
    top = t.agg(F.max("l_orderkey")).first()[0] + 1
    bucket = F.floor(F.col("l_orderkey") * buckets / F.lit(top)).cast("int")
    placed = with_position(t, LINE_KEY, bucket, out="row_id")
    labels = enc.fit_labels(t, FINE.of_role(CATEGORICAL), size_bound=largest(FINE))
    return enc.encode(placed, FINE, labels, ("row_id",)), rows


CURRENT = (
    f"placed AS (SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_id FROM lineitem), "
    + sql.encoded_ctes("placed", FINE, ("t.row_id",))
    + ", "
    + sql.binned_cte(FINE, DEPTH, extra="row_id, " + ", ".join(NAMES) + ", ")
)
STREAM = f"{SEED}|{RUN}|1"  # seed, run and round of the edit queries


# ---- H: generation ----


def _random_sql(c) -> str:
    a, b = sql.u(SEED, "init.bin", f"'{c.name}'", "row_id"), sql.u(SEED, "init.in", f"'{c.name}'", "row_id")
    if c.role == CATEGORICAL:
        return f"CAST(floor({a} * {c.size}) AS INTEGER) AS {c.name}"
    if c.role == ORDINAL:
        return f"CAST(floor({a} * {c.size}) AS BIGINT) AS {c.name}"
    if c.edges is None:
        return f"round({a}, 9) AS {c.name}"
    e = "[" + ", ".join(sql.d(x) for x in c.edges) + "]"
    i = f"CAST(floor({a} * {len(c.edges) - 1}) AS INTEGER)"
    return f"round({e}[{i} + 1] + {b} * ({e}[{i} + 2] - {e}[{i} + 1]), 9) AS {c.name}"


@query(
    "h1_random_table",
    f"WITH r AS (SELECT unnest(range((SELECT count(*) FROM lineitem))) AS row_id) SELECT row_id, "
    + ", ".join(_random_sql(c) for c in FINE.columns) + " FROM r",
)
def h1(spark, sf):
    """As many random rows as lineitem has."""
    t = random_table(spark, FINE, table(spark, sf, "lineitem").count(), SEED, exact_hash=True)
    return t.withColumns({n: F.round(n, 9) for n in FINE.of_role(CONTINUOUS)})


def _edits(n: int, ops: list[str]) -> Edits:
    return Edits(PAIRS, n, ops, SEED, RUN, draw=uniform_sql)


def _proposals(spark, sf, ops: list[str], quantiles=None):
    t, n = current_table(spark, sf)
    e = _edits(n, ops)
    q = quantiles or e.grid({})
    pairs = e.pairs(to_state(t, FINE, DEPTH), 1)
    p = e.propose(pairs, 1, [1.0 / len(ops)] * len(ops), q)
    return e, p.withColumn("op", F.get(array_lit(ops), "op"))


def _pick_sql(ids: list[int], tag: str, key: str) -> str:
    return f"[{', '.join(map(str, ids))}][CAST(floor({sql.u(STREAM, tag, key, '0')} * {len(ids)}) AS INTEGER) + 1]"


def _case(per_column: list[str], on: str = "c1") -> str:
    whens = " ".join(f"WHEN {on} = {i} THEN {x}" for i, x in enumerate(per_column))
    return f"CASE {whens} END"


def _bin_of_new(x: str) -> str:
    parts = []
    for c in FINE.columns:
        if c.edges is None:
            parts.append(f"CAST({x} AS BIGINT)")
        else:
            parts.append(sql.bin_case(x, c.edges))
    return _case(parts)


UA, UB = sql.u(STREAM, "value.bin", "row_id", "0"), sql.u(STREAM, "value.in", "row_id", "0")
BY_WEIGHT = [i for i, c in enumerate(FINE.columns) for _ in range(c.weight)]


def _mutated() -> str:
    out = []
    for c in FINE.columns:
        if c.edges is None:
            out.append(f"floor({UA} * {c.size})")
        else:
            e = "[" + ", ".join(sql.d(x) for x in c.edges) + "]"
            i = f"CAST(floor({UA} * {len(c.edges) - 1}) AS INTEGER)"
            out.append(f"{e}[{i} + 1] + {UB} * ({e}[{i} + 2] - {e}[{i} + 1])")
    return _case(out)


@query(
    "h2_mutate",
    f"WITH {CURRENT}, p AS (SELECT row_id, {_pick_sql(BY_WEIGHT, 'mutate.col', 'row_id')} AS c1 FROM binned), "
    f"x AS (SELECT row_id, c1, {_mutated()} AS x1 FROM p) "
    f"SELECT row_id, CAST(c1 AS INTEGER) AS c1, round(x1, 9) AS x1, CAST({_bin_of_new('x1')} AS INTEGER) AS y1 FROM x",
)
def h2(spark, sf):
    _, p = _proposals(spark, sf, [MUTATE])
    return p.select("row_id", "c1", F.round("x1", 9).alias("x1"), "y1")


# Cells that guided edits are offered, all of them: pairs of columns, weighed by the rows without flag R.
OFFERED = list(itertools.combinations([FINE.position(n) for n in NAMES if n != "l_returnflag"], 2))
_CELLS = " UNION ALL ".join(
    f"SELECT {a} AS f1, b_{NAMES[a]} AS i1, {b} AS f2, b_{NAMES[b]} AS i2, count(*) AS w FROM binned WHERE b_l_returnflag < 2 GROUP BY ALL"
    for a, b in OFFERED
)
_AT = "greatest(0, ({x}::HUGEINT * m - (t // 2) + t - 1) // t)"


def _in_bin(col: str, i: str, u: str) -> str:
    out = []
    for c in FINE.columns:
        if c.edges is None:
            out.append(f"CAST({i} AS DOUBLE)")
        else:
            e = "[" + ", ".join(sql.d(x) for x in c.edges) + "]"
            out.append(f"{e}[{i} + 1] + {u} * ({e}[{i} + 2] - {e}[{i} + 1])")
    return _case(out, col)


@query(
    "h2_guided_mutate",
    f"WITH {CURRENT}, cells AS ({_CELLS}), r AS (SELECT *, sum(w) OVER (ORDER BY f1, f2, i1, i2) AS upto FROM cells), "
    "tot AS (SELECT CAST(sum(w) AS HUGEINT) AS t, 2 * count(*) AS m FROM cells), "
    f"lh AS (SELECT f1, i1, f2, i2, m, {_AT.format(x='(upto - w)')} AS low, least({_AT.format(x='upto')}, m) AS high FROM r, tot), "
    "slots AS (SELECT f1, i1, f2, i2, m, unnest(range(low::BIGINT, high::BIGINT)) AS slot FROM lh WHERE low < high), "
    f"a AS (SELECT row_id, {sql.u(STREAM, 'fill.cell', 'row_id', '0')} AS uf, {UB} AS ub, "
    f"{sql.u(STREAM, 'fill.in', 'row_id', '0')} AS ub2 FROM binned), "
    "p AS (SELECT row_id, ub, ub2, f1 AS c1, i1, f2 AS c2, i2 FROM a, tot JOIN slots ON slot = CAST(floor(uf * tot.m) AS BIGINT)), "
    f"x AS (SELECT *, {_in_bin('c1', 'i1', 'ub')} AS x1, {_in_bin('c2', 'i2', 'ub2')} AS x2 FROM p) "
    f"SELECT row_id, CAST(c1 AS INTEGER) AS c1, round(x1, 9) AS x1, CAST({_bin_of_new('x1')} AS INTEGER) AS y1, "
    f"CAST(c2 AS INTEGER) AS c2, round(x2, 9) AS x2, CAST({_bin_of_new('x2').replace('c1 =', 'c2 =')} AS INTEGER) AS y2 FROM x",
)
def h2_guided(spark, sf):
    """Rows are put into cells that lack rows, drawn from a table of slots in proportion to what each lacks."""
    t, n = current_table(spark, sf)
    e = _edits(n, [FILL])
    state = to_state(t, FINE, DEPTH)
    pairs = [f"struct({a} as f1, get(b, {a}) as i1, {b} as f2, get(b, {b}) as i2)" for a, b in OFFERED]
    lacking = state.where(f"get(b, {FINE.position('l_returnflag')}) < 2").selectExpr(f"inline(array({', '.join(pairs)}))")
    cells = lacking.groupBy("f1", "i1", "f2", "i2").agg(F.count(F.lit(1)).alias("w"))
    slots = slots_of(cells, ["f1", "f2", "i1", "i2"], F.expr(f"f1 * {len(NAMES)} + f2"), 2 * cells.count(), 0.5)
    p = e.propose(e.pairs(state, 1), 1, [1.0], e.grid({}), slots)
    return p.select("row_id", "c1", F.round("x1", 9).alias("x1"), "y1", "c2", F.round("x2", 9).alias("x2"), "y2")


NUMERIC_IDS = [FINE.position(n) for n in FINE.of_role(CONTINUOUS) + FINE.of_role(ORDINAL)]
_Q_LISTS = ", ".join(
    f"list_concat([{sql.d(0)}], quantile_cont(CAST({c.name} AS DOUBLE), "
    f"[{', '.join(repr(p) for p in linspace(0.0, 1.0, QUANTILE_POINTS))}]), [{sql.d(c.size)}]) AS q_{c.name}"
    for c in FINE.columns
    if c.numeric
)


def _between() -> str:
    out = []
    for c in FINE.columns:
        if not c.numeric:
            out.append("NULL")
            continue
        j = f"CAST(floor({UA} * {QUANTILE_POINTS + 1}) AS INTEGER)"
        x = f"(q_{c.name}[{j} + 1] + {UB} * (q_{c.name}[{j} + 2] - q_{c.name}[{j} + 1]))"
        out.append(f"least(floor({x}), {c.size - 1})" if c.role == ORDINAL else x)
    return _case(out)


@query(
    "h3_quantile_edit",
    f"WITH {CURRENT}, q AS (SELECT {_Q_LISTS} FROM enc), "
    f"p AS (SELECT row_id, {_pick_sql(NUMERIC_IDS, 'quantile.col', 'row_id')} AS c1 FROM binned), "
    f"x AS (SELECT row_id, c1, {_between()} AS x1 FROM p, q) "
    "SELECT row_id, CAST(c1 AS INTEGER) AS c1, round(x1, 6) AS x1 FROM x",
)
def h3(spark, sf):
    """A value between two adjacent quantiles of the current table."""
    t, n = current_table(spark, sf)
    grid = {}
    numeric = FINE.of_role(CONTINUOUS, ORDINAL)
    for r in quantile_grid(t, FINE, numeric, QUANTILE_POINTS).orderBy("col", "i").collect():  # 34 per column
        grid.setdefault(r["col"], []).append(r["value"])
    q = [grid.get(n_, [0.0] * (QUANTILE_POINTS + 2)) for n_ in NAMES]
    e = _edits(n, [QUANTILE])
    p = e.propose(e.pairs(to_state(t, FINE, DEPTH), 1), 1, [1.0], q)
    return p.select("row_id", "c1", F.round("x1", 6).alias("x1"))


PAIRED = (
    "bits AS (SELECT count(*) AS n, greatest(1, CAST(ceil(log2(greatest(count(*), 2))) AS INTEGER)) AS k FROM enc), "
    "mask AS (SELECT n, CASE WHEN k > 1 THEN 1 + 2654435761 % ((1::BIGINT << k) - 1) ELSE 1 END AS m FROM bits), "
    "paired AS (SELECT a.*, least(a.row_id, xor(a.row_id, m)) AS pair_id, b.row_id AS other, "
    + ", ".join(f"b.{n} AS p_{n}, b.b_{n} AS pb_{n}" for n in NAMES)
    + " FROM binned a CROSS JOIN mask LEFT JOIN binned b ON b.row_id = xor(a.row_id, m))"
)
OTHER_VALUE = [f"CAST(p_{n} AS DOUBLE)" for n in NAMES]


@query(
    "h4_swap",
    f"WITH {CURRENT}, {PAIRED}, p AS (SELECT *, CASE WHEN other IS NOT NULL THEN "
    f"{_pick_sql(list(range(len(NAMES))), 'swap.col', 'pair_id')} END AS c1 FROM paired) "
    f"SELECT row_id, pair_id, CAST(c1 AS INTEGER) AS c1, round({_case(OTHER_VALUE)}, 9) AS x1 FROM p",
)
def h4(spark, sf):
    """Both rows of a pair propose each other's value in one column."""
    _, p = _proposals(spark, sf, [SWAP])
    return p.select("row_id", "pair_id", "c1", F.round("x1", 9).alias("x1"))


CAT_IDS = [FINE.position(n) for n in FINE.of_role(CATEGORICAL)]
_OP = f"CASE WHEN floor({sql.u(STREAM, 'op', 'pair_id', '0')} * 1000) < 500 THEN 'cross1' ELSE 'cross2' END"


@query(
    "h5_crossover",
    f"WITH {CURRENT}, {PAIRED}, o AS (SELECT *, CASE WHEN other IS NOT NULL THEN {_OP} END AS op FROM paired), "
    f"p AS (SELECT *, CASE WHEN op IS NOT NULL THEN {_pick_sql(CAT_IDS, 'copy.col1', 'row_id')} END AS c1, "
    f"CASE WHEN op = 'cross2' THEN {_pick_sql(CAT_IDS, 'copy.col2', 'row_id')} END AS c2_ FROM o), "
    "q AS (SELECT *, CASE WHEN c2_ <> c1 THEN c2_ END AS c2 FROM p) "
    f"SELECT row_id, op, CAST(c1 AS INTEGER) AS c1, {_case(OTHER_VALUE)} AS x1, CAST(c2 AS INTEGER) AS c2, "
    f"{_case(OTHER_VALUE, 'c2')} AS x2 FROM q",
)
def h5(spark, sf):
    """One or two categorical values are copied from the partner."""
    _, p = _proposals(spark, sf, [COPY1, COPY2])
    return p.select("row_id", "op", "c1", "x1", "c2", "x2")


# Scoring and acceptance: targets are the noisy statistics of lineitem's rows without flag R.
MIX = [MUTATE, SWAP, COPY2]
_TARGET = (
    f"tb AS (SELECT * FROM binned WHERE b_l_returnflag < 2), {sql.grid_cte(PAIRS, 'grid')}, "
    f"{sql.counts_cte(PAIRS, 'tc', 'tb')}, {sql.counts_cte(PAIRS, 'cc', 'binned')}, "
    "dense AS (SELECT g.workload_id, g.cell, coalesce(c.cnt, 0) / CAST((SELECT count(*) FROM tb) AS DOUBLE) AS stat "
    "FROM grid g LEFT JOIN tc c USING (workload_id, cell)), "
    f"{sql.noisy_cte(EACH, '(SELECT count(*) FROM tb)', SEED, RUN, 0, 'dense')}, "
    f"res AS (SELECT workload_id, cell, noised - coalesce(c.cnt, 0) / CAST(({N}) AS DOUBLE) AS r FROM meas "
    "LEFT JOIN cc c USING (workload_id, cell))"
)
_MIX_OP = (
    f"CASE WHEN floor({sql.u(STREAM, 'op', 'pair_id', '0')} * 1000) < 333 THEN 'mutate' "
    f"WHEN floor({sql.u(STREAM, 'op', 'pair_id', '0')} * 1000) < 667 THEN 'swap' ELSE 'cross2' END"
)
_MIX_SQL = (
    f"o AS (SELECT *, {_MIX_OP} AS op0 FROM paired), "
    "o1 AS (SELECT *, CASE WHEN op0 = 'mutate' OR other IS NOT NULL THEN op0 END AS op FROM o), "
    f"p AS (SELECT *, CASE op WHEN 'mutate' THEN {_pick_sql(BY_WEIGHT, 'mutate.col', 'row_id')} WHEN 'swap' THEN "
    f"{_pick_sql(list(range(len(NAMES))), 'swap.col', 'pair_id')} WHEN 'cross2' THEN "
    f"{_pick_sql(CAT_IDS, 'copy.col1', 'row_id')} END AS c1, CASE WHEN op = 'cross2' THEN "
    f"{_pick_sql(CAT_IDS, 'copy.col2', 'row_id')} END AS c2 FROM o1), "
    f"x AS (SELECT *, CASE WHEN op = 'mutate' THEN {_mutated()} END AS x1 FROM p), "
    "moved AS (SELECT row_id, pair_id, op, "
    + ", ".join(f"b_{n}" for n in NAMES)
    + ", "
    + ", ".join(
        f"CASE WHEN c1 = {i} AND op = 'mutate' THEN "
        + (f"CAST(x1 AS BIGINT)" if FINE[n].edges is None else sql.bin_case("x1", FINE[n].edges))
        + f" WHEN c1 = {i} OR c2 = {i} THEN pb_{n} ELSE b_{n} END AS nb_{n}"
        for i, n in enumerate(NAMES)
    )
    + " FROM x), units AS (SELECT *, CASE WHEN op = 'swap' THEN -1 - pair_id ELSE row_id END AS unit FROM moved), "
    "cells AS ("
    + " UNION ALL ".join(
        f"SELECT unit, {w.workload_id} AS workload_id, {sql.cell_sql(PAIRS, w, 'b_')} AS cell, -1 AS d FROM units WHERE op IS NOT NULL "
        f"UNION ALL SELECT unit, {w.workload_id}, {sql.cell_sql(PAIRS, w, 'nb_')}, 1 FROM units WHERE op IS NOT NULL"
        for w in PAIRS.workloads
    )
    + "), net AS (SELECT unit, workload_id, cell, sum(d) AS d FROM cells GROUP BY ALL HAVING sum(d) <> 0), "
    f"scored AS (SELECT unit, sum(-2 * r * d / CAST(({N}) AS DOUBLE) + d * d / (CAST(({N}) AS DOUBLE) * ({N}))) AS change "
    "FROM net JOIN res USING (workload_id, cell) GROUP BY unit)"
)


def _scored(spark, sf):
    t, n = current_table(spark, sf)
    target_rows = encoded_line(spark, sf, FINE).where("l_returnflag < 2")
    targets = ms.measure_all(CHAIN, target_rows, target_rows.count(), RHO, SEED, RUN)
    g = Generator(PAIRS, n, SEED, run=RUN)
    res = g.residuals(targets, t)
    e = _edits(n, MIX)
    pairs = e.pairs(to_state(t, FINE, DEPTH), 1)
    return e, res, e.best(pairs, 1, [1.0 / 3] * 3, e.grid({}), None, e.potentials(PAIRS.cell_map(spark), res))


@query(
    "h6_score_edits",
    f"WITH {CURRENT}, {PAIRED}, {_TARGET}, {_MIX_SQL} SELECT row_id, op, "
    "round(coalesce(change, 0), 13) + 0 AS change FROM units LEFT JOIN scored USING (unit)",
)
def h6(spark, sf):
    """Exact change of the squared distance for a mix of edits over every row."""
    _, _, s = _scored(spark, sf)
    return s.select("row_id", F.get(array_lit(MIX), "op").alias("op"), (F.round("change", 13) + 0.0).alias("change"))


COV_PAIRS = list(itertools.combinations(COV_COLS, 2))
_PRODUCT_BIN = [-9.0, *linspace(-2.0, 2.0, 64), 9.0]


def _product(a: str, b: str, edited: bool) -> str:
    """Interval of a product of two standardised columns, -1 and 63 outside; with the edit if ``edited``."""
    x = [f"CASE WHEN c1 = {FINE.position(c)} THEN x1 ELSE {c} END" if edited else c for c in (a, b)]
    z = [f"(({v} - m_{c}) / s_{c})" for v, c in zip(x, (a, b))]
    return f"{sql.bin_case(f'({z[0]} * {z[1]})', _PRODUCT_BIN)} - 1"


_PRODUCTS = " UNION ALL ".join(
    f"SELECT {i} AS w, row_id, l_returnflag < 2 AS wanted, {_product(a, b, False)} AS old, CASE WHEN c1 IN ({FINE.position(a)}, {FINE.position(b)}) "
    f"THEN {_product(a, b, True)} END AS new FROM edited, mo"
    for i, (a, b) in enumerate(COV_PAIRS)
)


@query(
    "h6_score_modules",
    f"WITH {CURRENT}, {COV_SQL.split(', z AS (')[0]}, "
    f"p AS (SELECT *, {_pick_sql(BY_WEIGHT, 'mutate.col', 'row_id')} AS c1 FROM enc), edited AS (SELECT *, {_mutated()} AS x1 FROM p), "
    f"prod AS ({_PRODUCTS}), cells AS (SELECT w, unnest(range(63)) AS cell FROM (SELECT unnest(range({len(COV_PAIRS)})) AS w)), "
    "n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE l_returnflag < 2) AS DOUBLE) AS t FROM enc), "
    "c AS (SELECT w, old AS cell, count(*) AS have, count(*) FILTER (WHERE wanted) AS want FROM prod GROUP BY ALL), "
    "res AS (SELECT w, cell, coalesce(want, 0) / t - coalesce(have, 0) / n AS r FROM cells CROSS JOIN n LEFT JOIN c USING (w, cell)), "
    "d AS (SELECT row_id, w, old AS cell, -1 AS d FROM prod WHERE new <> old UNION ALL SELECT row_id, w, new, 1 FROM prod WHERE new <> old), "
    "s AS (SELECT row_id, sum(1 / (n * n) - 2 * r * d / n) AS change FROM d JOIN res USING (w, cell), n GROUP BY row_id) "
    "SELECT row_id, round(coalesce(change, 0), 13) + 0 AS change FROM enc LEFT JOIN s USING (row_id)",
)
def h6_modules(spark, sf):
    """Exact change of the distance to product histograms, measured beside the marginals, for an edit of every row."""
    t, n = current_table(spark, sf)
    products = Covariance(FINE, line_moments(spark, sf))
    real = encoded_line(spark, sf, FINE).where("l_returnflag < 2")
    targets = Chain([products]).stats(real, real.count()).withColumnRenamed("stat", "noised")
    g = Generator(PAIRS, n, SEED, run=RUN, others=(products,))
    e = Edits(g.targets, n, [MUTATE], SEED, RUN, draw=uniform_sql)
    pairs = e.pairs(to_state(t, FINE, DEPTH), 1)
    scored = e.best(pairs, 1, [1.0], e.grid({}), None, e.potentials(g.targets.cell_map(spark), g.residuals(targets, t)))
    return scored.select("row_id", (F.round("change", 13) + 0.0).alias("change"))


_LEVELS = (
    f"lv0 AS (SELECT unit, CAST(floor(log2(change / (SELECT min(change) FROM scored)) - "
    f"log2({sql.u(STREAM, 'level', 'unit')})) AS INTEGER) + 3 AS level FROM scored WHERE change < -1e-15), "
    "lv AS (SELECT * FROM lv0 WHERE level >= 0), top AS (SELECT greatest(1, CAST(ceil(log2(greatest(n, 2))) AS INTEGER) + 2) AS j FROM bits), "
    "js AS (SELECT unnest(range(j + 1)) AS j, j AS jmax FROM top)"
)


@query(
    "h7_accept_sets",
    f"WITH {CURRENT}, {PAIRED}, {_TARGET}, {_MIX_SQL}, {_LEVELS}, "
    "capped AS (SELECT unit, least(level, (SELECT max(jmax) FROM js)) AS level FROM lv), "
    "lvl_net AS (SELECT level, workload_id, cell, sum(d) AS d FROM net JOIN capped USING (unit) GROUP BY ALL), "
    "sets AS (SELECT js.j, workload_id, cell, sum(d) AS d FROM js JOIN lvl_net ON level >= js.j GROUP BY ALL), "
    f"e AS (SELECT sets.j, sum(d * d / (CAST(({N}) AS DOUBLE) * ({N})) - 2 * r * d / CAST(({N}) AS DOUBLE)) AS change FROM sets "
    "JOIN res USING (workload_id, cell) GROUP BY sets.j) "
    "SELECT CAST(js.j AS INTEGER) AS set_level, round(coalesce(change, 0), 9) + 0 AS change FROM js LEFT JOIN e ON e.j = js.j",
)
def h7(spark, sf):
    """Exact change of the distance for each nested set of improving edits; the best one is applied."""
    e, res, s = _scored(spark, sf)
    s = Workspace(spark, "accept").write(s, "scored")  # read twice
    top = s.agg(F.min("change").alias("top")).first()["top"]
    merged = res.join(e.set_deltas(e.with_levels(s, 1, top)), "key", "left")
    row = e.set_changes(merged)
    each = F.array(
        *[
            F.struct(F.lit(j).alias("set_level"), (F.round(F.coalesce(f"e{j}", F.lit(0.0)), 9) + 0.0).alias("change"))
            for j in range(e.max_level + 1)
        ]
    )
    return row.select(F.inline(each))


@query(
    "h8_fitness",
    f"WITH {DENSE}, {OTHER}, {sql.noisy_cte(EACH, N, SEED, RUN, 0, 'dense')} "
    "SELECT round(sum((noised - o.stat) ** 2), 9) AS fitness FROM meas JOIN other o USING (workload_id, cell)",
)
def h8(spark, sf):
    e, n, real, other = both(spark, sf)
    targets = ms.measure_all(CHAIN, e, n, RHO, SEED, RUN)
    return ms.fitness(targets, other).withColumn("fitness", F.round("fitness", 9))


@query(
    "h9_weight_update",
    "WITH a AS (SELECT event_type AS op, avg(CASE WHEN value > 250 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_id % 2 = 0) AS r1, "
    "avg(CASE WHEN value > 250 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_id % 2 = 1) AS r2 FROM events GROUP BY 1), "
    "n AS (SELECT count(*) AS n FROM a), b AS (SELECT *, exp(0.1 * r1 * n) / n AS raw FROM a, n), "
    "c AS (SELECT *, raw / sum(raw) OVER () AS w1 FROM b), d AS (SELECT *, w1 * exp(0.1 * r2 / (0.95 * w1 + 0.05 / n)) AS raw2 FROM c) "
    "SELECT op, round(w1, 9) AS first, round(raw2 / sum(raw2) OVER (), 9) AS second FROM d",
)
def h9_update(spark, sf):
    """Two updates of the operator weights, with kept shares taken from events."""
    high = F.when(F.col("value") > 250, 1.0).otherwise(0.0)
    even = F.col("event_id") % 2 == 0
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.avg(F.when(even, high)).alias("r1"), F.avg(F.when(~even, high)).alias("r2"))
    rows = sorted(rows.collect())  # one row per event type
    first = update_weights([1.0 / len(rows)] * len(rows), [r["r1"] for r in rows])
    second = update_weights(first, [r["r2"] for r in rows])
    out = [(r["event_type"], round(a, 9), round(b, 9)) for r, a, b in zip(rows, first, second)]
    return small_table(spark, out, "op string, first double, second double")


@query(
    "h10_stop_rule",
    "WITH h AS (SELECT extract(hour FROM ts) AS k, sum(CAST(round(value * 100) AS BIGINT)) AS v FROM events GROUP BY 1), "
    "f AS (SELECT k, row_number() OVER (ORDER BY k) AS n, CAST(sum(v) OVER (ORDER BY k DESC) AS DOUBLE) AS f FROM h), "
    "l AS (SELECT *, lag(f, 3) OVER (ORDER BY k) AS was FROM f) SELECT CAST(k AS INTEGER) AS k, f AS left_over, "
    "n > 5 AND coalesce(was = 0 OR abs(was - f) / was < 0.25, false) AS stops FROM l",
)
def h10_rule(spark, sf):
    """The stop rule on a history: what is left of the events' value from each hour on."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    rows = sorted(table(spark, sf, "events").groupBy(F.hour("ts").alias("k")).agg(cents.alias("v")).collect())  # 24 rows
    left = [float(sum(r["v"] for r in rows[i:])) for i in range(len(rows))]
    out = [(r["k"], left[i], should_stop(left[: i + 1], 0.25, 3, 5)) for i, r in enumerate(rows)]
    return small_table(spark, out, "k int, left_over double, stops boolean")


_START_OF = int(hashlib.md5(f"{SEED}|resample.start".encode()).hexdigest()[:13], 16)
_RESAMPLED = " UNION ALL ".join(
    f"SELECT '{name}' AS target, row_id, ((pos * n + o) // r)::BIGINT AS low, (((pos + 1) * n + o) // r)::BIGINT AS high "
    f"FROM (SELECT pos, row_id, r, o, {n} AS n FROM placed2)"
    for name, n in (("larger", "4 * r + 7"), ("smaller", "r // 4"))
)


@query(
    "h11_start_rows",
    f"WITH placed AS (SELECT *, row_number() OVER (ORDER BY {KEYS_SQL}) - 1 AS row_id FROM lineitem), "
    "rows AS (SELECT count(*)::HUGEINT AS r FROM lineitem), "
    f"placed2 AS (SELECT row_id, (row_number() OVER (ORDER BY {sql.u(SEED, 'resample', 'row_id')}, row_id) - 1)::HUGEINT AS pos, r, "
    f"({_START_OF}::HUGEINT * r) >> 52 AS o FROM placed, rows), sized AS ({_RESAMPLED}) "
    "SELECT target, row_id AS source_id, unnest(range(low, high)) AS row_id FROM sized",
)
def h11_rows(spark, sf):
    """A start table of another size: each row is copied as often as its place in a systematic sample says."""
    t, rows = current_table(spark, sf)
    t = t.select(F.col("row_id").alias("source_id"), F.col("row_id"))
    sized = {"larger": 4 * rows + 7, "smaller": rows // 4}
    made = [resample(t.drop("row_id"), n, SEED, ["source_id"], rows=rows).select(F.lit(name).alias("target"), "source_id", "row_id") for name, n in sized.items()]
    return made[0].union(made[1])


# Generation runs: as many synthetic rows as lineitem has. ``_fit`` and ``synthesize`` end by the operator's own stop
# rule. h12_chain_fit and h13_adaptive_fit end when the distance falls by less than THRESHOLD in two rounds over all rows.
LINE_PAIRS = mg.Marginals(LINE, mg.column_sets(LINE, 2), DEPTH)
LINE_CHAIN = Chain([LINE_PAIRS])
STOP = {"stop_window": 2, "min_rounds": 2}
THRESHOLD = 0.3
SHORT = {"stop_threshold": 0.5, "stop_window": 2, "min_rounds": 2, "singly": 0}


def _fit(spark, sf, start=None, on_start=None, **kw):
    e = encoded_line(spark, sf, LINE)
    n = e.count()
    g = Generator(LINE_PAIRS, n, SEED, run="fit", **{"singly": SINGLY, **kw})
    return fit_zcdp(g, LINE_CHAIN, e, n, 50.0, "fit", start, on_start)[0], e, n


@query("h9_operator_weights")
def h9(spark, sf):
    """Weight of every edit operator per round, updated by what was kept."""
    fitted, _, _ = _fit(spark, sf)
    return fitted.log_frame(spark).select("round", "op", "proposed", "kept", "weight")


@query("h10_early_stop")
def h10(spark, sf):
    """Fitness per round; the run ends when it falls by less than half over two rounds."""
    fitted, _, _ = _fit(spark, sf, **SHORT)
    return fitted.log_frame(spark).groupBy("round", "fitness").agg(F.bool_or("converged").alias("converged"))


@query("h11_warm_start")
def h11(spark, sf):
    """Start from the table of a shorter run and go on."""
    first, _, _ = _fit(spark, sf, **SHORT)
    more, _, _ = _fit(spark, sf, start=first.table, on_start=first.work.close)
    return more.log_frame(spark).select("round", "fitness").distinct()


@query("h12_private_fit")
def h12(spark, sf):
    """Measure once, search: the encoded synthetic table."""
    return _fit(spark, sf)[0].table


@query("h12_chain_fit")
def h12_chain(spark, sf):
    """A fit to three modules at once: what is left of each one's distance from a random table."""
    e = encoded_line(spark, sf, LINE)
    n = e.count()
    chain = Chain([LINE_PAIRS, Covariance(LINE, line_moments(spark, sf)), NullCounts(LINE)])
    g = Generator(LINE_PAIRS, n, SEED, run="chain", stop_threshold=THRESHOLD, **STOP)
    fitted, measured = fit_zcdp(g, chain, e, n, 50.0)

    def left(t):
        gap = F.col("noised") - F.coalesce("stat", F.lit(0.0))
        joined = measured.join(chain.stats(t, n).select(*ms.KEY, "stat"), ms.KEY, "left")
        return joined.groupBy("module").agg(F.sum(gap * gap).alias("distance"))

    start = left(g.start_table(spark)).withColumnRenamed("distance", "start")
    return start.join(left(fitted.table), "module")


@query("h13_adaptive_fit")
def h13(spark, sf):
    """Two rounds of picking the two worst workloads, measuring them and refitting."""
    e = encoded_line(spark, sf, LINE)
    n = e.count()
    g = Generator(LINE_PAIRS, n, SEED, run="adaptive", stop_threshold=THRESHOLD, **STOP)
    fitted, measured = fit_dp_adaptive(g, LINE_CHAIN, e, n, 2, 100.0, 1e-6, k=2, warm=True)
    return measured.select("round", "workload_id", "cell", "noised")


META = {
    "l_returnflag": {"type": "string"},
    "l_linestatus": {"type": "string"},
    "l_quantity": {"type": "int", "lower": 1, "upper": 50},
    "l_discount": {"type": "float", "lower": 0.0, "upper": 0.1},
    "l_extendedprice": {"type": "float", "lower": 900.0, "upper": 105000.0},
}


def synthesize(data, **kw) -> TableSynthesizer:
    return TableSynthesizer(1e4, 1e-5, seed=SEED).fit(data.select(*META), META, **kw)


@query("h14_synthesize")
def h14(spark, sf):
    """Private edges, private marginals, search, decode: a synthetic lineitem of the same size."""
    return synthesize(table(spark, sf, "lineitem")).sample()


# ---- I: evaluation ----


@query(
    "i1_total_error",
    f"WITH {DENSE}, {OTHER} SELECT round(max(abs(a.stat - b.stat)), 9) AS max_error, round(avg(abs(a.stat - b.stat)), 9) "
    "AS mean_error FROM dense a JOIN other b USING (workload_id, cell)",
)
def i1(spark, sf):
    _, _, real, other = both(spark, sf)
    t = ev.total_error(real, other)
    return t.select(F.round("max_error", 9).alias("max_error"), F.round("mean_error", 9).alias("mean_error"))


_NEW = OTHER.replace("oenc", "nenc").replace("ocnt", "ncnt").replace("other AS", "newer AS").replace(
    "b_l_returnflag < 2", "b_l_linenumber < 6"
)


@query(
    "i2_round_report",
    f"WITH {DENSE}, {OTHER}, {_NEW}, {sql.noisy_cte(EACH, N, SEED, RUN, 0, 'dense')}, "
    "j AS (SELECT d.workload_id, d.stat AS ds, o.stat AS os, n.stat AS ns, m.noised FROM dense d JOIN other o USING (workload_id, cell) "
    "JOIN newer n USING (workload_id, cell) JOIN meas m USING (workload_id, cell)) "
    "SELECT 3 AS round, "
    + ", ".join(
        f"round({f}(abs(ds - {x})) {w}, 9) AS {name}_{suffix}"
        for name, x, w in (
            ("before", "os", "FILTER (WHERE workload_id IN (0, 7, 9))"),
            ("after", "ns", "FILTER (WHERE workload_id IN (0, 7, 9))"),
            ("gaussian", "noised", "FILTER (WHERE workload_id IN (0, 7, 9))"),
            ("total", "ns", ""),
        )
        for f, suffix in (("max", "max"), ("avg", "mean"))
    )
    + " FROM j",
)
def i2(spark, sf):
    """Errors around a round: the table before lacks flag R, the one after lacks line 7."""
    e, n, real, before = both(spark, sf)
    newer = e.where("l_linenumber < 6")
    after = CHAIN.stats(newer, newer.count())
    m = ms.measure_all(CHAIN, e, n, RHO, SEED, RUN).where("workload_id in (0, 7, 9)")
    r = ev.round_report(m, real, before, after, 3)
    return r.select("round", *[F.round(c, 9).alias(c) for c in r.columns if c != "round"])


_I3_EDGES = {"value": list(linspace(0.0, 600.0, 31)), "user_id": list(linspace(0.0, 1500.0, 16))}


@query(
    "i3_feature_distributions",
    f"WITH s AS (SELECT *, CASE WHEN {sql.u(SEED, 'split', 'event_id')} < {sql.d(0.5)} THEN 'train' ELSE 'test' END AS source "
    "FROM events), "
    + "h AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, CAST({sql.bin_case(n, e)} AS BIGINT) AS bin, source, count(*) AS cnt FROM s GROUP BY ALL"
        for n, e in _I3_EDGES.items()
    )
    + ") SELECT feature, bin, source, cnt, cnt / CAST(sum(cnt) OVER (PARTITION BY feature, source) AS DOUBLE) AS density FROM h",
)
def i3(spark, sf):
    a, b = smp.bernoulli_split(table(spark, sf, "events"), 0.5, SEED, ["event_id"])
    return ev.feature_distributions(a, b, _I3_EDGES, ("train", "test"))


@query("i4_train_on_synthetic")
def i4(spark, sf):
    """A classifier of the return flag, trained on real and on synthetic rows, tested on real rows."""
    fold = F.pmod(F.xxhash64(*META), F.lit(5))
    marked = table(spark, sf, "lineitem").select(*META, fold.alias("fold"))
    s = synthesize(marked.where("fold > 0"))  # neither side sees the test rows
    test = enc.encode(marked.where("fold = 0"), s.domain, s.labels)
    tables = {"real": s.encoded, "synthetic": s.synthetic}
    return ev.classifier_accuracy(tables, test, "l_returnflag", s.domain)

