"""Budget, private measurement and selection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veiltab.functions.literals import small_table
from veiltab.functions.budget import cdp_rho, split_budget
from veiltab.operators import marginals as mg
from veiltab.operators import measure as ms
from veiltab.operators.domain import linspace
from veiltab.operators.modules import Chain, NullCounts
from veiltab.plans import oracle as sql
from veiltab.plans.queries_stats import DEPTH, ENC, _sets_sql, fitted_line, rows_sql
from veiltab.plans.queries_tables import LINE, SEED, encoded_line
from veiltab.plans.registry import query
from veiltab.plans.synthesizer import ledger_table

RUN = "r1"
RHO = 0.05
N = rows_sql("enc")
# Finer edges for the two continuous columns, as private edges would give.
FINE = LINE.with_edges({"l_discount": linspace(0.0, 1.0, 33), "l_extendedprice": linspace(0.0, 1.0, 64)})
PAIRS = mg.Marginals(FINE, mg.column_sets(FINE, 2), DEPTH)
CHAIN = Chain([PAIRS])
EACH = RHO / PAIRS.n_workloads
WIDEST = max(w.n_cells for w in PAIRS.workloads)
BINNED = sql.binned_cte(FINE, DEPTH)
DENSE = f"{ENC}, {BINNED}, {sql.dense_cte(PAIRS, N)}"
MEASURED = f"{DENSE}, {sql.noisy_cte(EACH, N, SEED, RUN, 0, 'dense')}"
# A second table to compare with: the rows that are not flagged R.
OTHER = (
    f"oenc AS (SELECT * FROM binned WHERE b_l_returnflag < 2), {sql.counts_cte(PAIRS, 'ocnt', 'oenc')}, "
    "other AS (SELECT g.workload_id, g.cell, coalesce(c.cnt, 0) / CAST((SELECT count(*) FROM oenc) AS DOUBLE) AS stat "
    "FROM grid_dense g LEFT JOIN ocnt c USING (workload_id, cell))"
)
ERRORS = (
    "errors AS (SELECT 'marginals' AS module, workload_id, max(abs(a.stat - b.stat)) AS max_error FROM dense a "
    "JOIN other b USING (workload_id, cell) GROUP BY workload_id)"
)


def both(spark, sf):
    """Statistics of lineitem and of its rows without flag R."""
    e = encoded_line(spark, sf, FINE)
    other = e.where("l_returnflag < 2")
    n, m = e.count(), other.count()
    return e, n, CHAIN.stats(e, n), CHAIN.stats(other, m)


def measured(spark, sf):
    e = encoded_line(spark, sf, FINE)
    return ms.measure_all(CHAIN, e, e.count(), RHO, SEED, RUN)


_G1_RHO = cdp_rho(1.0, 1e-9)
_G1_EDGES, _G1_PAIRS = split_budget(_G1_RHO, 2, 6)
_G1_WORKLOADS = 15 * 3 - 2


@query(
    "g1_budget_ledger",
    f"SELECT 'marginals' AS step, cols || '/' || level AS scope, round({sql.d(_G1_PAIRS / _G1_WORKLOADS)}, 12) AS rho "
    f"FROM ({_sets_sql(2, 'true')}) UNION ALL SELECT 'edges', unnest(['l_discount', 'l_extendedprice']), "
    f"round({sql.d(_G1_EDGES / 2)}, 12)",
)
def g1(spark, sf):
    d = fitted_line(spark, sf)
    chain = Chain([mg.Marginals.all_kway(d, 2, DEPTH)])
    return ledger_table(cdp_rho(1.0, 1e-9), d, chain, 64, spark).withColumn("rho", F.round("rho", 12))


@query(
    "g2_private_measurement",
    f"WITH {MEASURED} SELECT workload_id, cell, round(noised, 6) AS noised, round(sigma, 9) AS sigma FROM meas",
)
def g2(spark, sf):
    m = measured(spark, sf)
    return m.select("workload_id", "cell", F.round("noised", 6).alias("noised"), F.round("sigma", 9).alias("sigma"))


@query(
    "g3_measure_one_module",
    f"WITH {ENC}, dense AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS workload_id, 0 AS cell, count(*) FILTER (WHERE {c} IS NULL) / CAST(count(*) AS DOUBLE) AS stat FROM enc"
        for i, c in enumerate(LINE.names)
    )
    + f"), {sql.noisy_cte(1e-7 / 6, N, SEED, RUN, 0, 'dense', module='null_counts')} "
    "SELECT 'null_counts' AS module, workload_id, round(noised, 6) AS noised FROM meas",
)
def g3(spark, sf):
    e = encoded_line(spark, sf, FINE)
    chain = Chain([PAIRS, NullCounts(FINE)])
    m = ms.measure_all(chain, e, e.count(), 1e-7, SEED, RUN, modules=["null_counts"])
    return m.select("module", "workload_id", F.round("noised", 6).alias("noised"))


@query(
    "g4_workload_errors",
    f"WITH {DENSE}, {OTHER}, {ERRORS} SELECT module, workload_id, round(max_error, 9) AS max_error FROM errors",
)
def g4(spark, sf):
    _, _, real, other = both(spark, sf)
    return ms.workload_errors(real, other).withColumn("max_error", F.round("max_error", 9))


G5_K, G5_RHO = 4, 0.02
_G5_SCALE = f"({sql.d(math.sqrt(G5_K) / math.sqrt(G5_RHO))} / CAST(({N}) AS DOUBLE))"
_G5_PICK = (
    f"scored AS (SELECT *, max_error + {_G5_SCALE} * "
    + sql.gumbel(SEED, "select", f"'{RUN}'", "1", "module", "workload_id")
    + f" AS score FROM errors WHERE workload_id NOT IN (0, 1)), "
    f"picks AS (SELECT workload_id FROM scored ORDER BY score DESC, workload_id LIMIT {G5_K})"
)


@query(
    "g5_select_and_measure",
    sql.materialized(
        f"WITH {DENSE}, {OTHER}, {ERRORS}, {_G5_PICK}, "
        "part AS (SELECT d.* FROM dense d SEMI JOIN picks USING (workload_id)), "
        f"{sql.noisy_cte(G5_RHO / 2 / G5_K, N, SEED, RUN, 1, 'part')} "
        "SELECT workload_id, cell, round(noised, 6) AS noised, 1 AS round FROM meas",
        "enc", "binned", "oenc", "cnts_dense", "ocnt", "dense", "other", "errors", "picks", "part",
    ),
)
def g5(spark, sf):
    """Half of the budget picks four workloads that were not picked before, half measures them."""
    e, n, real, other = both(spark, sf)
    done = small_table(spark, [("marginals", 0), ("marginals", 1)], "module string, workload_id int")
    m = ms.select_and_measure(CHAIN, e, real, other, n, G5_RHO, G5_K, SEED, RUN, 1, done)
    return m.select("workload_id", "cell", F.round("noised", 6).alias("noised"), "round")


@query(
    "g6_exponential_choice",
    f"WITH {DENSE}, {OTHER}, {ERRORS}, w AS (SELECT *, exp({sql.d(2000.0)} * (max_error - max(max_error) OVER ())) AS w FROM errors), "
    "c AS (SELECT *, sum(w) OVER (ORDER BY module, workload_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS c FROM w) "
    f"SELECT workload_id, round(max_error, 9) AS score FROM c WHERE c >= {sql.u(SEED, 'choice', repr(RUN), '1')} ORDER BY c LIMIT 1",
)
def g6(spark, sf):
    _, _, real, other = both(spark, sf)
    errors = ms.workload_errors(real, other).withColumnRenamed("max_error", "score")
    one = ms.exponential_choice(errors, 2.0, 0.001, SEED, ms.WORKLOAD, RUN, 1)
    return one.select("workload_id", F.round("score", 9).alias("score"))


@query(
    "g7_trim_sparse",
    f"WITH {MEASURED}, r AS (SELECT *, row_number() OVER (PARTITION BY workload_id ORDER BY noised DESC, cell) AS rk FROM meas) "
    "SELECT workload_id, cell, round(noised, 6) AS noised FROM r WHERE rk <= 100",
)
def g7(spark, sf):
    kept = ms.trim(measured(spark, sf), 100, WIDEST)
    return kept.select("workload_id", "cell", F.round("noised", 6).alias("noised"))


@query(
    "g8_selected_vectors",
    f"WITH {MEASURED} SELECT workload_id, cell, round(noised, 6) AS noised, stat AS true_stat FROM meas WHERE workload_id IN (0, 7)",
)
def g8(spark, sf):
    """Measured values beside the true ones (a diagnostic), for two picked workloads."""
    e = encoded_line(spark, sf, FINE)
    n = e.count()
    real = CHAIN.stats(e, n)
    m = ms.measure_all(CHAIN, e, n, RHO, SEED, RUN).where("workload_id in (0, 7)")
    return ms.selected_vectors(m, real).select("workload_id", "cell", F.round("noised", 6).alias("noised"), "true_stat")


@query(
    "g8_reselect",
    f"WITH {MEASURED} SELECT workload_id, count(*) AS n_cells FROM meas WHERE workload_id NOT IN (0, 7) GROUP BY 1",
)
def g8_reset(spark, sf):
    """What is left after the measurements of two workloads are withdrawn."""
    gone = small_table(spark, [("marginals", 0), ("marginals", 7)], "module string, workload_id int")
    left = ms.without(measured(spark, sf), gone)
    return left.groupBy("workload_id").agg(F.count(F.lit(1)).alias("n_cells"))
