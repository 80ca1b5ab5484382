"""Edges, histograms, quantiles and marginals."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from veiltab.functions.bins import bin_table
from veiltab.operators import encode as enc
from veiltab.operators import histograms as hist
from veiltab.operators import marginals as mg
from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, fit_domain, linspace
from veiltab.operators.modules import Chain, Covariance, NullCounts, SparseCounts, _Rates
from veiltab.operators.tree_marginals import TreeMarginals
from veiltab.plans import oracle as sql
from veiltab.plans.queries_tables import DOC_SQL, LINE, SEED, doc_labels, encoded_line, largest
from veiltab.plans.registry import query, table
from veiltab.streaming.changes import apply_changes

ENC = sql.encoded_ctes("lineitem", LINE)
NUMERIC = ["l_linenumber", "l_quantity", "l_discount", "l_extendedprice"]
WIDE = ["l_discount", "l_extendedprice"]
DEPTH = 3
PAIRS = mg.Marginals(LINE, mg.column_sets(LINE, 2), DEPTH)
LINE_ROLES = {c.name: c.role for c in LINE.columns}
LINE_BOUNDS = {c.name: (c.lo, c.hi) for c in LINE.columns if c.role != CATEGORICAL}


def rows_sql(source: str = "lineitem") -> str:
    return f"SELECT count(*) FROM {source}"


def fitted_line(spark, sf):
    """Domain of lineitem with declared numeric bounds and label counts from the table."""
    return fit_domain(table(spark, sf, "lineitem"), LINE_ROLES, LINE_BOUNDS)


LINE_DOMAIN_SQL = " UNION ALL ".join(
    f"SELECT '{c.name}' AS col, {i} AS pos, '{c.role}' AS role, "
    + (
        f"(SELECT count(DISTINCT {c.name}) FROM lineitem)"
        if c.role == CATEGORICAL
        else str(c.size)
    )
    + " AS size"
    for i, c in enumerate(LINE.columns)
)


# ---- E: bins, histograms, quantiles ----


@query(
    "e1_default_edges",
    f"WITH dom AS ({LINE_DOMAIN_SQL}), n AS (SELECT col, CASE role WHEN 'continuous' THEN 8 ELSE size + 1 END AS n, "
    "CASE role WHEN 'continuous' THEN 1 ELSE size END AS top FROM dom WHERE role <> 'categorical'), "
    "g AS (SELECT col, n, top, unnest(range(n)) AS i FROM n) "
    "SELECT col, i, round(CAST(i AS DOUBLE) * top / (n - 1), 9) AS edge FROM g",
)
def e1(spark, sf):
    e = hist.default_edges(fitted_line(spark, sf).frame(spark), 3)
    return e.withColumn("edge", F.round("edge", 9))


@query(
    "e2_dyadic_edges",
    f"WITH dom AS ({LINE_DOMAIN_SQL}), h AS (SELECT col, role, CASE role WHEN 'continuous' THEN 1 ELSE size END AS top, "
    "CASE role WHEN 'categorical' THEN 1 WHEN 'ordinal' THEN least(floor(log2(size) + 1), 5) ELSE 5 END AS h FROM dom), "
    "l AS (SELECT col, role, top, CAST(unnest(range(CAST(h AS BIGINT))) AS INTEGER) AS level FROM h), "
    "n AS (SELECT col, level, top, CASE role WHEN 'categorical' THEN CAST(top AS BIGINT) ELSE "
    "CAST(2 ** (level + 1) AS BIGINT) END AS n FROM l), g AS (SELECT *, unnest(range(n + 1)) AS i FROM n) "
    "SELECT col, level, i, round(CAST(i AS DOUBLE) * top / n, 9) AS edge FROM g",
)
def e2(spark, sf):
    e = hist.dyadic_edge_table(fitted_line(spark, sf).frame(spark), 5)
    return e.withColumn("edge", F.round("edge", 9))


def adaptive_sql(domain: Domain, names: list[str], k: int, granularity: float, rho: float) -> str:
    """CTEs ending in hist(col, left_, right_, stat): the halving tree, level by level."""
    n = f"CAST(({rows_sql('enc')}) AS DOUBLE)"
    heights = {c: hist.tree_height(domain[c], k, granularity) for c in names}
    out, finals = [], []
    for c in names:
        lo, hi = domain[c].range
        h, tag = heights[c], f"t_{c}"
        step = 1.0 if domain[c].role == ORDINAL else granularity
        sigma = f"({sql.d(math.sqrt(2.0 * (h + 1)))} / {n} / {sql.d(math.sqrt(2.0 * rho))})"
        leaves = k * 2**h
        leaf = f"greatest(0, least({leaves - 1}, floor(({c} - {sql.d(lo)}) / {sql.d(hi - lo)} * {sql.d(leaves)})))"
        out.append(f"{tag}_leaf AS (SELECT CAST({leaf} AS BIGINT) AS leaf, count(*) AS cnt FROM enc "
                   f"WHERE {c} IS NOT NULL GROUP BY 1)")

        def sums(level: int) -> str:
            return (f"(SELECT leaf // {2 ** (h - level)} AS node, sum(cnt) AS cnt FROM {tag}_leaf GROUP BY 1)")

        def share(level: int) -> str:
            z = sql.gauss(SEED, "edges", f"'{c}'", str(level), "g.node")
            return sql.clip01(f"coalesce(s.cnt, 0) / {n} + {sigma} * {z}")

        def scaled(mass: str, over: str, count: int) -> str:
            t = f"sum(x) OVER ({over})"
            return f"CASE WHEN {t} < 1e-9 THEN {mass} / {count} ELSE {mass} * x / {t} END"

        out.append(f"{tag}_raw0 AS (SELECT g.node, {share(0)} AS x FROM (SELECT unnest(range({k})) AS node) g "
                   f"LEFT JOIN {sums(0)} s USING (node))")
        out.append(f"{tag}_0 AS (SELECT node, {scaled(sql.d(1), '', k)} AS stat FROM {tag}_raw0)")
        for level in range(h):
            width = (hi - lo) / (k * 2**level)
            split = f"stat > {sql.d(1.0 / k)}" if width > step else "false"
            finals.append(f"SELECT '{c}' AS col, {sql.d(lo)} + node * {sql.d(width)} AS left_, {sql.d(lo)} + "
                          f"(node + 1) * {sql.d(width)} AS right_, stat FROM {tag}_{level} WHERE NOT ({split})")
            out.append(f"{tag}_g{level + 1} AS (SELECT node AS parent, stat AS mass, unnest([2 * node, 2 * node + 1]) "
                       f"AS node FROM {tag}_{level} WHERE {split})")
            out.append(f"{tag}_raw{level + 1} AS (SELECT g.*, {share(level + 1)} AS x FROM {tag}_g{level + 1} g "
                       f"LEFT JOIN {sums(level + 1)} s USING (node))")
            out.append(f"{tag}_{level + 1} AS (SELECT node, {scaled('mass', 'PARTITION BY parent', 2)} AS stat "
                       f"FROM {tag}_raw{level + 1})")
        width = (hi - lo) / (k * 2**h)
        finals.append(f"SELECT '{c}' AS col, {sql.d(lo)} + node * {sql.d(width)} AS left_, {sql.d(lo)} + "
                      f"(node + 1) * {sql.d(width)} AS right_, stat FROM {tag}_{h}")
    return ", ".join(out) + f", hist AS ({' UNION ALL '.join(finals)})"


E3_K, E3_RHO = 64, 0.01


@query(
    "e3_adaptive_histogram",
    f"WITH {ENC}, {adaptive_sql(LINE, WIDE, E3_K, 0.001, E3_RHO)} "
    "SELECT col, round(left_, 9) AS left_edge, round(right_, 9) AS right_edge, round(stat, 6) AS stat FROM hist",
)
def e3_hist(spark, sf):
    e = encoded_line(spark, sf)
    h = hist.adaptive_histogram(e, LINE, WIDE, e.count(), E3_RHO, E3_K, 0.001, SEED)
    return h.select("col", F.round("left", 9).alias("left_edge"), F.round("right", 9).alias("right_edge"),
                    F.round("stat", 6).alias("stat"))


@query(
    "e3_private_edges",
    f"WITH {ENC}, {adaptive_sql(LINE, WIDE, E3_K, 0.001, E3_RHO)}, "
    "cum AS (SELECT *, sum(stat) OVER (PARTITION BY col ORDER BY left_ ROWS UNBOUNDED PRECEDING) AS c FROM hist), "
    "q AS (SELECT *, c / max(c) OVER (PARTITION BY col) AS hi_q FROM cum), "
    "r AS (SELECT *, coalesce(lag(hi_q) OVER (PARTITION BY col ORDER BY left_), 0) AS lo_q FROM q), "
    f"asked AS (SELECT unnest(range({E3_K})) AS i), "
    f"hit AS (SELECT r.*, i, CAST(i AS DOUBLE) / {E3_K - 1} AS p FROM r JOIN asked ON hi_q > lo_q AND "
    f"i >= lo_q * {E3_K - 1} AND (i < hi_q * {E3_K - 1} OR hi_q >= 1)) "
    "SELECT col, i, round(left_ + (p - lo_q) / (hi_q - lo_q) * (right_ - left_), 6) AS edge FROM hit",
)
def e3_edges(spark, sf):
    e = encoded_line(spark, sf)
    h = hist.adaptive_histogram(e, LINE, WIDE, e.count(), E3_RHO, E3_K, 0.001, SEED)
    return hist.equal_mass_edges(h, E3_K).withColumn("edge", F.round("edge", 6))


E4_EDGES = {n: list(linspace(0.0, 1.0, 21)) for n in WIDE}


def _hist_cte(edges: dict[str, list[float]], source: str = "enc") -> str:
    """h(col, bin, cnt) with empty bins."""
    parts = []
    for n, e in edges.items():
        parts.append(
            f"SELECT '{n}' AS col, g.bin, coalesce(c.cnt, 0) AS cnt FROM (SELECT unnest(range({len(e) - 1})) AS bin) g "
            f"LEFT JOIN (SELECT {sql.bin_case(n, e)} AS bin, count(*) AS cnt FROM {source} GROUP BY 1) c ON c.bin = g.bin"
        )
    return f"h AS ({' UNION ALL '.join(parts)})"


@query(
    "e4_noisy_histogram",
    f"WITH {ENC}, {_hist_cte(E4_EDGES)}, s AS (SELECT col, bin, cnt, "
    + sql.clip01(f"cnt / CAST(({rows_sql('enc')}) AS DOUBLE) + {sql.d(0.01)} * " + sql.gauss(SEED, "histogram", "col", "bin"))
    + " AS x FROM h) SELECT col, CAST(bin AS INTEGER) AS bin, round(x / sum(x) OVER (PARTITION BY col), 6) AS stat FROM s",
)
def e4(spark, sf):
    e = encoded_line(spark, sf)
    h = hist.noisy_histogram(e, E4_EDGES, e.count(), 0.01, SEED)
    return h.select("col", "bin", F.round("stat", 6).alias("stat"))


E5_DOMAIN = LINE.with_edges({"l_extendedprice": linspace(0.0, 1.0, 64), "l_quantity": linspace(0.0, 50.0, 5)})


@query(
    "e5_bin_levels",
    f"WITH {ENC}, {sql.binned_cte(E5_DOMAIN, DEPTH)} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS col, {lvl} AS level, CAST(least(b_{n} // {st}, {cnt - 1}) AS BIGINT) AS bin, count(*) AS cnt "
        f"FROM binned GROUP BY 3"
        for n in E5_DOMAIN.names
        for lvl in range(DEPTH)
        for st, cnt in [E5_DOMAIN[n].coarse(DEPTH, lvl)]
    ),
)
def e5(spark, sf):
    """Finest bins by search, coarser ones by division, for every column and level."""
    m = mg.Marginals(E5_DOMAIN, mg.column_sets(E5_DOMAIN, 1), DEPTH)
    b = bin_table(encoded_line(spark, sf, E5_DOMAIN), E5_DOMAIN, DEPTH)
    cells = F.array(
        *[
            F.struct(
                F.lit(c.name).alias("col"), F.lit(lvl).alias("level"),
                F.least(F.floor(F.col(f"b_{c.name}") / st), F.lit(n - 1)).cast("long").alias("bin"),
            )
            for c in m.domain.columns
            for lvl in range(DEPTH)
            for st, n in [c.coarse(DEPTH, lvl)]
        ]
    )
    return (
        b.select(F.explode(cells).alias("c")).select("c.*").groupBy("col", "level", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


CATS = LINE.of_role(CATEGORICAL)


@query(
    "e6_noisy_categories",
    f"WITH {ENC}, h AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS col, g.label, coalesce(c.cnt, 0) AS cnt FROM (SELECT CAST(unnest(range({LINE[n].size})) AS INTEGER) "
        f"AS label) g LEFT JOIN (SELECT {n} AS label, count(*) AS cnt FROM enc GROUP BY 1) c ON c.label = g.label"
        for n in CATS
    )
    + f") SELECT col, label, round(cnt / CAST(({rows_sql('enc')}) AS DOUBLE) + {sql.d(math.sqrt(2.0))} / "
    f"({rows_sql('enc')}) / {sql.d(math.sqrt(2 * 0.001))} * " + sql.gauss(SEED, "categories", "col", "label")
    + ", 6) AS stat FROM h",
)
def e6(spark, sf):
    e = encoded_line(spark, sf)
    return hist.noisy_categories(e, LINE, CATS, e.count(), 0.001, SEED).withColumn("stat", F.round("stat", 6))


TREE_H = 6


TREE_SQL = (
    f"WITH {ENC}, leaf AS (SELECT CAST(least({2**TREE_H - 1}, floor(l_extendedprice * {2**TREE_H})) AS BIGINT) AS leaf, "
    "count(*) AS cnt FROM enc GROUP BY 1), "
    "tree AS ("
    + " UNION ALL ".join(
        f"SELECT {lvl} AS level, g.bin, coalesce(c.cnt, 0) AS cnt FROM (SELECT unnest(range({2 ** (lvl + 1)})) AS bin) g "
        f"LEFT JOIN (SELECT leaf // {2 ** (TREE_H - 1 - lvl)} AS bin, sum(cnt) AS cnt FROM leaf GROUP BY 1) c ON c.bin = g.bin"
        for lvl in range(TREE_H)
    )
    + f"), noisy AS (SELECT level, bin, cnt / CAST(({rows_sql('enc')}) AS DOUBLE) + {sql.d(math.sqrt(2.0))} / "
    f"({rows_sql('enc')}) / {sql.d(math.sqrt(2 * 0.01 / TREE_H))} * "
    + sql.gauss(SEED, "tree", "'l_extendedprice'", "level", "bin")
    + f" AS stat FROM tree), e AS (SELECT unnest(range(1, {2**TREE_H})) AS i), "
    "mass AS (SELECT i, sum(stat) AS mass FROM e JOIN noisy ON "
    f"(i // CAST(2 ** ({TREE_H - 1} - level) AS BIGINT)) % 2 = 1 AND bin = (i // CAST(2 ** ({TREE_H - 1} - level) AS BIGINT)) - 1 "
    "GROUP BY i)"
)


@query("e7_tree_prefix_mass", f"{TREE_SQL} SELECT i, round(mass, 6) AS mass FROM mass")
def e7(spark, sf):
    """Mass below each leaf edge of the noisy dyadic tree of one column."""
    stats = _noisy_tree(spark, sf)
    return hist.prefix_mass(stats, TREE_H).withColumn("mass", F.round("mass", 6))


def _noisy_tree(spark, sf):
    e = encoded_line(spark, sf)
    t = TreeMarginals(LINE, [("l_extendedprice",)], TREE_H)
    return t.noisy_stats(e, e.count(), 0.01, SEED, "tree").select("level", F.col("b1").alias("bin"), "stat")


TREE_Q = 16


@query(
    "e7_tree_quantiles",
    TREE_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f", edges AS (SELECT i, mass FROM mass UNION ALL SELECT 0, 0.0), nxt AS (SELECT a.i, min(b.i) - 1 AS j FROM edges a "
    f"JOIN mass b ON b.i - 1 > a.i AND b.mass > a.mass + {sql.d(1.0 / TREE_Q)} GROUP BY a.i), "
    "cuts AS (SELECT CAST(0 AS BIGINT) AS i UNION ALL SELECT j FROM cuts JOIN nxt USING (i)) "
    f"SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS i, i / CAST({2**TREE_H} AS DOUBLE) AS edge FROM cuts",
)
def e7_cuts(spark, sf):
    return hist.tree_quantiles(_noisy_tree(spark, sf), 1.0, TREE_H, TREE_Q)


CDF_AT = {"l_extendedprice": [0.05, 0.25, 0.5, 0.9, 1.0], "l_quantity": [0.0, 1.0, 10.0, 25.5, 49.0, 60.0]}


@query(
    "e8_cdf",
    f"WITH {ENC} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS col, {sql.d(t)} AS threshold, count(*) FILTER (WHERE {n} < {sql.d(t)}) / "
        f"CAST(count(*) AS DOUBLE) AS stat FROM enc"
        for n, ts in CDF_AT.items()
        for t in ts
    ),
)
def e8(spark, sf):
    e = encoded_line(spark, sf)
    return hist.cdf(e, CDF_AT, e.count())


@query(
    "e9_max_coverage",
    f"WITH {ENC}, {_hist_cte(E4_EDGES)} SELECT col, max(cnt) / CAST(({rows_sql('enc')}) AS DOUBLE) AS max_mass "
    "FROM h GROUP BY col",
)
def e9(spark, sf):
    e = encoded_line(spark, sf)
    return hist.max_coverage(e, E4_EDGES, e.count())


@query(
    "e10_quantile_grid",
    f"WITH {ENC}, q AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS col, unnest(range(1, 33)) AS i, unnest(quantile_cont(CAST({n} AS DOUBLE), "
        f"[{', '.join(repr(p) for p in linspace(0.0, 1.0, 32))}])) AS value FROM enc"
        for n in NUMERIC
    )
    + "), ends AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}', 0, {sql.d(0)} UNION ALL SELECT '{n}', 33, {sql.d(LINE[n].size)}" for n in NUMERIC
    )
    + ") SELECT col, CAST(i AS INTEGER) AS i, round(value, 6) AS value FROM (SELECT * FROM q UNION ALL SELECT * FROM ends)",
)
def e10(spark, sf):
    q = hist.quantile_grid(encoded_line(spark, sf), LINE, NUMERIC)
    return q.withColumn("value", F.round("value", 6))


# ---- F: statistics ----


def _sets_frame(spark, m: mg.Marginals):
    """cols, level, n_cells of every workload."""
    w = m.frame(spark)
    return w.select(F.concat_ws(",", "cols").alias("cols"), "level", "n_cells")


def _sets_sql(k: int, where: str) -> str:
    """Workloads by self-joining the domain rows; bins per column and level from its size."""
    bins = (
        f"dom AS ({LINE_DOMAIN_SQL}), lv AS (SELECT unnest(range({DEPTH})) AS level), "
        "e AS (SELECT col, pos, role, size, level, CASE role WHEN 'continuous' THEN 8 ELSE size + 1 END AS n_e, "
        "CAST(2 ** level AS BIGINT) AS p FROM dom, lv), "
        "s AS (SELECT *, CASE WHEN n_e // p < 3 THEN greatest(1, n_e // 2) ELSE p END AS st FROM e), "
        "b AS (SELECT col, pos, role, size, level, CASE role WHEN 'categorical' THEN size ELSE "
        "greatest(1, CAST(ceil((n_e - st) / CAST(st AS DOUBLE)) AS BIGINT)) END AS n FROM s)"
    )
    t = [f"x{i}" for i in range(k)]
    joins = " ".join(
        f"JOIN b {t[i]} ON {t[i]}.pos > {t[i - 1]}.pos AND {t[i]}.level = {t[0]}.level" for i in range(1, k)
    )
    numeric = " OR ".join(f"{x}.role <> 'categorical'" for x in t)
    cols = " || ',' || ".join(f"{x}.col" for x in t)
    return (
        f"WITH {bins} SELECT {cols} AS cols, CAST({t[0]}.level AS INTEGER) AS level, "
        f"CAST({' * '.join(f'{x}.n' for x in t)} AS BIGINT) AS n_cells FROM b x0 {joins} "
        f"WHERE ({t[0]}.level = 0 OR {numeric}) AND {where}"
    )


_F1_SIZE = " * ".join(f"CASE WHEN x{i}.size > 1 THEN x{i}.size ELSE 64 END" for i in range(3))


@query(
    "f1_column_sets",
    _sets_sql(3, f"{_F1_SIZE} < 30000 AND ('l_returnflag' IN (x0.col, x1.col, x2.col))"),
)
def f1(spark, sf):
    d = fitted_line(spark, sf)
    return _sets_frame(spark, mg.Marginals.all_kway(d, 3, DEPTH, max_size=30000, include="l_returnflag"))


@query(
    "f2_mixed_sets",
    _sets_sql(2, "((x0.role = 'categorical') <> (x1.role = 'categorical'))"),
)
def f2(spark, sf):
    d = fitted_line(spark, sf)
    return _sets_frame(spark, mg.Marginals(d, mg.mixed_sets(d, 2), DEPTH))


@query(
    "f3_conditional_sets",
    _sets_sql(2, "'l_linestatus' NOT IN (x0.col, x1.col)").replace("AS cols,", "|| ',l_linestatus' AS cols,")
    .replace("AS BIGINT) AS n_cells", "AS BIGINT) * (SELECT size FROM dom WHERE col = 'l_linestatus') AS n_cells"),
)
def f3(spark, sf):
    d = fitted_line(spark, sf)
    return _sets_frame(spark, mg.Marginals(d, mg.conditional_sets(d, 2, ["l_linestatus"]), DEPTH))


F3_SETS = mg.Marginals(
    LINE.project(["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]),
    mg.conditional_sets(
        LINE.project(["l_returnflag", "l_linestatus", "l_linenumber", "l_discount"]), 2, ["l_linestatus"]
    ),
    DEPTH,
)


@query(
    "f3_conditional_marginals",
    f"WITH {ENC}, {sql.binned_cte(LINE, DEPTH)}, {sql.counts_cte(F3_SETS)} "
    f"SELECT workload_id, cell, cnt, cnt / CAST(({rows_sql('enc')}) AS DOUBLE) AS stat FROM cnts",
)
def f3_counts(spark, sf):
    e = encoded_line(spark, sf)
    return F3_SETS.stats(e, e.count(), dense=False)


def _bins_sql(m: mg.Marginals, source: str) -> str:
    """cell -> b1, b2."""
    parts = []
    for w in m.workloads:
        n2 = w.dims[1].width
        parts.append(
            f"SELECT workload_id, {w.level} AS level, cell // {n2} AS b1, cell % {n2} AS b2, cnt, stat FROM {source} "
            f"WHERE workload_id = {w.workload_id}"
        )
    return " UNION ALL ".join(parts)


@query(
    "f4_marginals",
    f"WITH {ENC}, {sql.binned_cte(LINE, DEPTH)}, {sql.counts_cte(PAIRS)}, st AS (SELECT workload_id, cell, cnt, "
    f"cnt / CAST(({rows_sql('enc')}) AS DOUBLE) AS stat FROM cnts) {_bins_sql(PAIRS, 'st')}",
)
def f4(spark, sf):
    e = encoded_line(spark, sf)
    stats = PAIRS.stats(e, e.count(), dense=False)
    return PAIRS.with_bins(stats).select("workload_id", "level", "b1", "b2", "cnt", "stat")


@query(
    "f4_three_way",
    (lambda m: f"WITH {ENC}, {sql.binned_cte(LINE, DEPTH)}, {sql.counts_cte(m)} SELECT workload_id, cell, cnt FROM cnts")(
        mg.Marginals(LINE, mg.column_sets(LINE, 3, 100_000, "l_returnflag"), DEPTH)
    ),
)
def f4_three(spark, sf):
    return mg.Marginals(LINE, mg.column_sets(LINE, 3, 100_000, "l_returnflag"), DEPTH).counts(encoded_line(spark, sf))


NULL_DOMAIN = Domain(
    (
        Column("lang", CATEGORICAL, 4, 0.0, 4.0),
        Column("n_chars", ORDINAL, 200001, 0.0, 200000.0, edges=linspace(0.0, 200001.0, 33)),
        Column("quality", ORDINAL, 2, 0.0, 1.0, has_nulls=True),
        Column("toxic", CATEGORICAL, 2, 0.0, 2.0, has_nulls=True),
    )
)
NULL_PAIRS = mg.Marginals(NULL_DOMAIN, mg.column_sets(NULL_DOMAIN, 2), DEPTH)


def encoded_docs(spark, sf, domain: Domain = NULL_DOMAIN):
    t = doc_labels(spark, sf)
    return enc.encode(t, domain, enc.fit_labels(t, domain.of_role(CATEGORICAL), size_bound=largest(domain)))


@query(
    "f4_nullable_marginals",
    f"WITH {DOC_SQL}, {sql.encoded_ctes('docs', NULL_DOMAIN)}, {sql.binned_cte(NULL_DOMAIN, DEPTH)}, "
    f"{sql.counts_cte(NULL_PAIRS)} SELECT workload_id, cell, cnt FROM cnts",
)
def f4_null(spark, sf):
    """NULL is a bin of its own, on every level."""
    return NULL_PAIRS.counts(encoded_docs(spark, sf))


@query(
    "f5_marginals_dense",
    f"WITH {ENC}, {sql.binned_cte(LINE, DEPTH)}, {sql.dense_cte(PAIRS, rows_sql('enc'))} {_bins_sql(PAIRS, 'dense')}",
)
def f5(spark, sf):
    e = encoded_line(spark, sf)
    stats = PAIRS.stats(e, e.count())
    return PAIRS.with_bins(stats).select("workload_id", "level", "b1", "b2", "cnt", "stat")


PICKED = [0, 5, 11, 20]


@query(
    "f6_selected_workloads",
    f"WITH {ENC}, {sql.binned_cte(LINE, DEPTH)}, {sql.dense_cte(PAIRS, rows_sql('enc'), only=PICKED)} "
    "SELECT workload_id, cell, cnt, stat FROM dense",
)
def f6(spark, sf):
    e = encoded_line(spark, sf)
    return PAIRS.stats(e, e.count(), PICKED)


TREE = TreeMarginals(LINE, mg.conditional_sets(LINE.project(["l_linestatus", "l_quantity", "l_discount"]), 2), 4)


def tree_sql(t: TreeMarginals, rho: float) -> str:
    parts = []
    for w in t.workloads:
        h = t.height_of(w.cols)
        sigma = math.sqrt(2.0) / math.sqrt(2.0 * rho / len(t.sets) / h)
        bins = ["floor({c} * {n} / {top})".format(c=c, n=n, top=sql.d(t.domain[c].range[1])) for c, n in zip(w.cols, w.bins)]
        bins = [f"CAST(greatest(0, least({n - 1}, {b})) AS BIGINT)" for b, n in zip(bins, w.bins)]
        grid = ", ".join(f"(SELECT unnest(range({n})) AS b{i + 1})" for i, n in enumerate(w.bins))
        keys = ", ".join(f"b{i + 1}" for i in range(len(w.cols)))
        cell = "0"
        for i, n in enumerate(w.bins):
            cell = f"({cell}) * {n} + b{i + 1}"
        z = sql.gauss(SEED, "tree2", f"'{','.join(w.cols)}'", str(w.level), cell)
        parts.append(
            f"SELECT '{','.join(w.cols)}' AS cols, {w.level} AS level, {keys}, round(coalesce(cnt, 0) / "
            f"CAST(({rows_sql('enc')}) AS DOUBLE) + {sql.d(sigma)} / ({rows_sql('enc')}) * {z}, 6) AS stat FROM "
            f"(SELECT * FROM {grid}) g LEFT JOIN (SELECT {', '.join(f'{b} AS b{i + 1}' for i, b in enumerate(bins))}, "
            f"count(*) AS cnt FROM enc GROUP BY ALL) c USING ({keys})"
        )
    return f"WITH {ENC} " + " UNION ALL ".join(parts)


@query("f7_tree_marginals", tree_sql(TREE, 0.05))
def f7(spark, sf):
    e = encoded_line(spark, sf)
    s = TREE.noisy_stats(e, e.count(), 0.05, SEED, "tree2")
    return s.select("cols", "level", "b1", "b2", F.round("stat", 6).alias("stat"))


F8_EDGES = {"l_discount": list(linspace(0.0, 1.0, 6)), "l_extendedprice": list(linspace(0.0, 1.0, 9)),
            "l_linenumber": [0.0, 2.0, 5.0, 7.0]}


@query(
    "f8_dense_histogram",
    f"WITH {ENC}, b AS (SELECT "
    + ", ".join(f"{sql.bin_case(n, e)} AS b{i}" for i, (n, e) in enumerate(F8_EDGES.items(), 1))
    + " FROM enc), c AS (SELECT b1, b2, b3, count(*) AS cnt FROM b GROUP BY ALL), g AS (SELECT * FROM "
    + ", ".join(f"(SELECT unnest(range({len(e) - 1})) AS b{i}) t{i}" for i, e in enumerate(F8_EDGES.values(), 1))
    + ") SELECT b1, b2, b3, "
    + ", ".join(
        f"CAST({lst}[b{i} + {s}] AS DOUBLE) AS {nm}{i}"
        for i, e in enumerate(F8_EDGES.values(), 1)
        for lst in ["[" + ", ".join(sql.d(x) for x in e) + "]"]
        for nm, s in (("lo", 1), ("hi", 2))
    )
    + f", coalesce(cnt, 0) / CAST(({rows_sql('enc')}) AS DOUBLE) AS stat FROM g LEFT JOIN c USING (b1, b2, b3)",
)
def f8(spark, sf):
    e = encoded_line(spark, sf)
    return mg.dense_histogram(e, F8_EDGES, e.count())


# (query id, column -> [lower, upper)); overlapping boxes that form no grid.
BOXES = [
    (0, {"l_discount": (0.1, 0.45), "l_extendedprice": (0.2, 0.9)}),
    (1, {"l_discount": (0.3, 0.85), "l_extendedprice": (0.0, 0.5)}),
    (2, {"l_quantity": (5.0, 20.0), "l_extendedprice": (0.25, 0.75)}),
    (3, {"l_quantity": (0.0, 50.0), "l_extendedprice": (0.7, 0.71)}),
    (4, {"l_quantity": (48.5, 60.0), "l_discount": (0.0, 2.0)}),
]


@query(
    "f9_box_queries",
    f"WITH {ENC} "
    + " UNION ALL ".join(
        f"SELECT {q} AS query_id, count(*) FILTER (WHERE "
        + " AND ".join(f"{c} >= {sql.d(lo)} AND {c} < {sql.d(hi)}" for c, (lo, hi) in box.items())
        + ") / CAST(count(*) AS DOUBLE) AS stat FROM enc"
        for q, box in BOXES
    ),
)
def f9(spark, sf):
    e = encoded_line(spark, sf)
    return mg.box_queries(e, BOXES, e.count())


COV_COLS = ["l_discount", "l_extendedprice", "l_linenumber", "l_quantity"]  # continuous, then ordinal


def line_moments(spark, sf) -> dict:
    e = encoded_line(spark, sf)
    aggs = [F.round(f(F.col(c)), 4).alias(f"{a}_{c}") for c in COV_COLS for a, f in (("m", F.avg), ("s", F.stddev_pop))]
    r = e.agg(*aggs).first()
    return {c: {"mean": r[f"m_{c}"], "std": r[f"s_{c}"]} for c in COV_COLS}


COV_SQL = (
    "mo AS (SELECT "
    + ", ".join(f"round(avg({c}), 4) AS m_{c}, round(stddev_pop({c}), 4) AS s_{c}" for c in COV_COLS)
    + " FROM enc), z AS (SELECT "
    + ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in COV_COLS)
    + " FROM enc, mo), cov AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS workload_id, {sql.bin_case(f'(z_{a} * z_{b})', [-9.0, *linspace(-2.0, 2.0, 64), 9.0])} - 1 AS cell, "
        f"count(*) AS cnt FROM z GROUP BY 2"
        for i, (a, b) in enumerate(itertools.combinations(COV_COLS, 2))
    )
    + ")"
)


@query(
    "f10_product_histogram",
    f"WITH {ENC}, {COV_SQL} SELECT workload_id, CAST(cell AS BIGINT) AS cell, cnt FROM cov WHERE cell BETWEEN 0 AND 62",
)
def f10(spark, sf):
    return Covariance(LINE, line_moments(spark, sf)).counts(encoded_line(spark, sf))


@query(
    "f11_null_rates",
    f"WITH {DOC_SQL} "
    + " UNION ALL ".join(
        f"SELECT {i} AS workload_id, count(*) FILTER (WHERE {c} IS NULL) AS cnt, count(*) FILTER (WHERE {c} IS NULL) / "
        f"CAST(count(*) AS DOUBLE) AS stat FROM docs"
        for i, c in enumerate(["n_chars", "quality", "toxic"])
    ),
)
def f11(spark, sf):
    t = doc_labels(spark, sf)
    return NullCounts(NULL_DOMAIN, ["n_chars", "quality", "toxic"]).stats(t, t.count()).drop("cell")


SPARSE_DOMAIN = Domain(
    (
        Column("quality", ORDINAL, 2, 0.0, 1.0, True, sparse=True),
        Column("n_chars", ORDINAL, 200001, 0.0, 200000.0),
        Column("toxic", ORDINAL, 2, 0.0, 1.0, True, sparse=True),
    )
)


@query(
    "f12_zero_rates",
    f"WITH {DOC_SQL} "
    + " UNION ALL ".join(
        f"SELECT {i} AS workload_id, count(*) FILTER (WHERE abs({c}) < 1e-9) AS cnt, count(*) FILTER (WHERE abs({c}) < 1e-9) / "
        f"CAST(count(*) AS DOUBLE) AS stat FROM docs"
        for i, c in enumerate(["quality", "toxic"])
    ),
)
def f12(spark, sf):
    t = doc_labels(spark, sf)
    return SparseCounts(SPARSE_DOMAIN).stats(t, t.count()).drop("cell")


@query(
    "f13_chained_modules",
    f"WITH {ENC}, {sql.binned_cte(LINE, DEPTH)}, {sql.dense_cte(PAIRS, rows_sql('enc'))}, {COV_SQL} "
    "SELECT 'marginals' AS module, workload_id, cell, cnt FROM dense UNION ALL "
    "SELECT 'covariance', g.workload_id, g.cell, coalesce(c.cnt, 0) FROM (SELECT unnest(range(6)) AS workload_id) a, "
    "LATERAL (SELECT a.workload_id, unnest(range(63)) AS cell) g LEFT JOIN cov c ON c.workload_id = g.workload_id AND "
    "c.cell = g.cell UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'null_counts', {i}, 0, count(*) FILTER (WHERE {c} IS NULL) FROM enc" for i, c in enumerate(LINE.names)
    ),
)
def f13(spark, sf):
    e = encoded_line(spark, sf)
    chain = Chain([PAIRS, Covariance(LINE, line_moments(spark, sf)), NullCounts(LINE)])
    return chain.stats(e, e.count()).drop("stat").withColumn("workload_id", F.col("workload_id").cast("long"))


@query(
    "f14_maintained_counts",
    f"WITH {sql.encoded_ctes('lineitem', LINE, ('t.l_returnflag AS raw_flag',), 'enc0')}, "
    "enc AS (SELECT * FROM enc0 WHERE raw_flag <> 'A'), "
    f"{sql.binned_cte(LINE, DEPTH)}, {sql.counts_cte(PAIRS)} SELECT workload_id, cell, cnt FROM cnts",
)
def f14(spark, sf):
    """Counts of the rows flagged A or N, then all A removed and all R added: equals a recount of N and R."""
    e = encoded_line(spark, sf)
    old = PAIRS.counts(e.where("l_returnflag in (0, 1)"))
    return apply_changes(old, PAIRS, e.where("l_returnflag = 2"), e.where("l_returnflag = 0"))


class UpperHalf(_Rates):
    """A user-defined module: share of rows in the upper half of each numeric column's range."""

    name = "upper_half"

    def __init__(self, domain: Domain):
        super().__init__(domain.of_role(ORDINAL, CONTINUOUS))
        self.middle = {n: sum(domain[n].range) / 2 for n in self.names}

    def condition(self, name: str):
        return F.col(name) >= F.lit(self.middle[name])


@query(
    "f15_user_module",
    f"WITH {ENC} "
    + " UNION ALL ".join(
        f"SELECT {i} AS workload_id, count(*) FILTER (WHERE {n} >= {sql.d(sum(LINE[n].range) / 2)}) AS cnt FROM enc"
        for i, n in enumerate(LINE.of_role(ORDINAL, CONTINUOUS))
    ),
)
def f15(spark, sf):
    e = encoded_line(spark, sf)
    return Chain([UpperHalf(LINE)]).stats(e, e.count()).select("workload_id", "cnt")



# ---- F4 on awkward keys ----

NARROW = Domain((Column("l_returnflag", CATEGORICAL, 2), Column("l_linestatus", CATEGORICAL, 2)))
HUGE_SIZE = 40_000
HUGE = Domain(tuple(Column(n, ORDINAL, HUGE_SIZE, 0.0, HUGE_SIZE - 1.0) for n in ("l_orderkey", "l_partkey", "l_suppkey")))


@query(
    "f4_out_of_range",
    f"WITH {ENC} SELECT 0 AS workload_id, CAST(l_returnflag * 2 + l_linestatus AS BIGINT) AS cell, count(*) AS cnt "
    "FROM enc WHERE l_returnflag BETWEEN 0 AND 1 AND l_linestatus BETWEEN 0 AND 1 GROUP BY ALL",
)
def f4_out_of_range(spark, sf):
    """A label beyond the declared size is in no cell."""
    m = mg.Marginals(NARROW, [("l_returnflag", "l_linestatus")], 1)
    return m.counts(encoded_line(spark, sf)).select("workload_id", "cell", "cnt")


@query(
    "f4_wide_keys",
    f"SELECT 0 AS workload_id, (least({HUGE_SIZE - 1}, l_orderkey) * {HUGE_SIZE} + least({HUGE_SIZE - 1}, l_partkey)) * "
    f"CAST({HUGE_SIZE} AS BIGINT) + least({HUGE_SIZE - 1}, l_suppkey) AS cell, count(*) AS cnt FROM lineitem GROUP BY ALL",
)
def f4_wide_keys(spark, sf):
    """A set with more than 2^44 cells."""
    m = mg.Marginals(HUGE, [tuple(HUGE.names)], 1)
    return m.counts(table(spark, sf, "lineitem").select(*HUGE.names)).select("workload_id", "cell", "cnt")
