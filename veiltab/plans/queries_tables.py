"""Sources, domain, sampling and encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.operators import encode as enc
from veiltab.operators import sampling as smp
from veiltab.operators.domain import (
    CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, column_weights, fit_domain, role_table,
)
from veiltab.operators.histograms import private_bounds
from veiltab.plans import oracle as sql
from veiltab.plans.registry import query, table
from veiltab.session import Workspace
from veiltab.sources.tables import load, read_delimited, read_domain, save

SEED = "s1"

# Declared (public) sizes and bounds of the lineitem columns used throughout.
LINE = Domain(
    (
        Column("l_returnflag", CATEGORICAL, 3, 0.0, 3.0),
        Column("l_linestatus", CATEGORICAL, 2, 0.0, 2.0),
        Column("l_linenumber", ORDINAL, 7, 1.0, 7.0),
        Column("l_quantity", ORDINAL, 50, 1.0, 50.0),
        Column("l_discount", CONTINUOUS, 1, 0.0, 0.1),
        Column("l_extendedprice", CONTINUOUS, 1, 900.0, 105000.0),
    )
)
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
ORDERS = Domain(
    (
        Column("o_orderstatus", CATEGORICAL, 3, 0.0, 3.0),
        Column("o_orderpriority", CATEGORICAL, 5, 0.0, 5.0),
        Column("o_totalprice", CONTINUOUS, 1, 0.0, 500000.0),
    )
)
LINE_CONFIG = {
    "l_returnflag": {"type": "string", "size": 3},
    "l_quantity": {"type": "int", "size": 50, "lower": 1, "upper": 50},
    "l_extendedprice": {"type": "float", "lower": 900, "upper": 105000},
}


def largest(domain: Domain) -> int:
    """Declared size of the largest categorical column."""
    return max(domain[n].size for n in domain.of_role(CATEGORICAL))


def encoded_line(spark: SparkSession, sf: str, domain: Domain = LINE) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return enc.encode(t, domain, enc.fit_labels(t, domain.of_role(CATEGORICAL), size_bound=largest(domain)))


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels, NULL where a document has none."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf, "labels"), "doc_id", "left")


DOC_SQL = (
    "docs AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
)


# ---- A: sources and sinks ----


@query("a1_load_domain_columns", "SELECT l_returnflag, l_quantity, l_extendedprice FROM lineitem")
def a1(spark, sf):
    return load(spark, f"{sf.rstrip('/')}/lineitem.parquet", read_domain(LINE_CONFIG))


@query(
    "a2_read_delimited",
    "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders",
)
def a2(spark, sf):
    """A delimited copy of orders, written by Spark, read back with given names and separator."""
    path = Workspace(spark, "a2").path
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    t.write.option("sep", ";").option("header", True).csv(path)
    kinds = {"id": "bigint", "price": "double"}
    return read_delimited(spark, path, ["id", "status", "price"], ";", True, kinds)


@query("a3_save_and_read", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def a3(spark, sf):
    path = Workspace(spark, "a3").path
    save(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return spark.read.parquet(path)


# ---- B: schema and domain ----


@query(
    "b1_resolve_roles",
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, "
        + (
            "'categorical'"
            if kind == "s"
            else f"CASE WHEN count(*) FILTER (WHERE {c} <> floor({c})) > 0 THEN 'continuous' "
            f"WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'ordinal' END"
        )
        + f" AS role, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM "
        + ("lineitem" if c.startswith("l_") else "docs")
        for c, kind in [
            ("l_orderkey", "n"), ("l_linenumber", "n"), ("l_quantity", "n"), ("l_extendedprice", "n"),
            ("l_discount", "n"), ("l_returnflag", "s"), ("l_linestatus", "s"),
        ]
    ),
)
def b1(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag",
            "l_linestatus"]
    return role_table(table(spark, sf, "lineitem").select(*cols), 20).select("col", "role", "n_null")


def _domain_sql(rows: list[tuple[str, str, str]]) -> str:
    parts = []
    for i, (src, c, role) in enumerate(rows):
        if role == CATEGORICAL:
            size, lo, hi = f"count(DISTINCT {c})", sql.d(0), f"CAST(count(DISTINCT {c}) AS DOUBLE)"
        else:
            lo, hi = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
            size = f"CAST({hi} - {lo} + 1 AS BIGINT)" if role == ORDINAL else "1"
        parts.append(
            f"SELECT '{c}' AS col, {i} AS pos, '{role}' AS role, {size} AS size, {lo} + 0 AS lo, "
            f"{hi} AS hi, count(*) FILTER (WHERE {c} IS NULL) > 0 AS has_nulls FROM {src}"
        )
    return " UNION ALL ".join(parts)


DOC_ROLES = {"lang": CATEGORICAL, "source": CATEGORICAL, "n_chars": ORDINAL, "quality": ORDINAL,
             "toxic": CATEGORICAL}


@query(
    "b2_fit_domain", f"WITH {DOC_SQL} " + _domain_sql([("docs", c, r) for c, r in DOC_ROLES.items()])
)
def b2(spark, sf):
    d = fit_domain(doc_labels(spark, sf), DOC_ROLES, nullable=None)
    return d.frame(spark).drop("edges")


@query(
    "b2_domain_subset",
    f"WITH {DOC_SQL}, dom AS ({_domain_sql([('docs', c, r) for c, r in DOC_ROLES.items()])}) "
    "SELECT col, CASE col WHEN 'quality' THEN 0 WHEN 'lang' THEN 1 ELSE 2 END AS pos, size FROM dom "
    "WHERE col IN ('quality', 'lang') OR col NOT IN ('quality', 'lang', 'source', 'toxic')",
)
def b2_subset(spark, sf):
    """Reorder and subset, then the complement of a column list."""
    d = fit_domain(doc_labels(spark, sf), DOC_ROLES, nullable=None)
    rest = d.complement(["quality", "lang", "source", "toxic"])
    return d.project(["quality", "lang", *rest]).frame(spark).select("col", "pos", "size")


@query(
    "b3_column_weights",
    f"WITH {DOC_SQL}, dom AS ({_domain_sql([('docs', c, r) for c, r in DOC_ROLES.items()])}) "
    "SELECT col, CAST(floor(ln(CASE WHEN col = 'n_chars' THEN 64 ELSE size END) + 1) AS BIGINT) AS weight FROM dom",
)
def b3(spark, sf):
    d = fit_domain(doc_labels(spark, sf), DOC_ROLES, nullable=None)
    d = d.with_edges({"n_chars": [float(i) for i in range(64)]})
    return column_weights(d, spark).select("col", "weight")


# ---- C: projection, sampling, splitting ----


@query("c1_project", "SELECT o_orderpriority, o_totalprice FROM orders")
def c1(spark, sf):
    return smp.project(table(spark, sf, "orders"), ORDERS, ["o_orderpriority", "o_totalprice"])[0]


@query("c2_drop", "SELECT o_orderstatus, o_totalprice FROM orders")
def c2(spark, sf):
    return smp.drop(table(spark, sf, "orders"), ORDERS, ["o_orderpriority"])[0]


@query(
    "c3_sample_fraction",
    f"SELECT event_id, value FROM events WHERE {sql.u(SEED, 'sample', 'event_id')} < {sql.d(0.2)}",
)
def c3(spark, sf):
    t = table(spark, sf, "events").select("event_id", "value")
    return smp.sample_fraction(t, 0.2, SEED, ["event_id"])


_TIMES = " + ".join(f"CASE WHEN u >= {sql.d(x)} THEN 1 ELSE 0 END" for x in smp.poisson_limits(0.5))


@query(
    "c3_sample_with_replacement",
    f"WITH t AS (SELECT event_id, value, {sql.u(SEED, 'sample', 'event_id')} AS u FROM events) "
    f"SELECT event_id, value FROM (SELECT event_id, value, unnest(range({_TIMES})) AS i FROM t)",
)
def c3_replace(spark, sf):
    t = table(spark, sf, "events").select("event_id", "value")
    return smp.sample_fraction(t, 0.5, SEED, ["event_id"], replace=True)


@query(
    "c4_sample_n",
    f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {sql.u(SEED, 'sample_n', 'o_orderkey')}, "
    "o_orderkey LIMIT 700",
)
def c4(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return smp.sample_n(t, 700, SEED, ["o_orderkey"])


@query(
    "c4_sample_n_with_replacement",
    "WITH n AS (SELECT count(*) AS n FROM customer), "
    f"placed AS (SELECT c_custkey, row_number() OVER (ORDER BY {sql.u(SEED, 'sample_n', 'c_custkey')}, "
    "c_custkey) - 1 AS pos FROM customer), "
    "draws AS (SELECT unnest(range(3 * n)) AS id, n FROM n), "
    f"picked AS (SELECT CAST(floor({sql.u(SEED, 'draw', 'id')} * n) AS BIGINT) AS pos FROM draws) "
    "SELECT c_custkey FROM picked JOIN placed USING (pos)",
)
def c4_replace(spark, sf):
    """Three times as many rows as the table has."""
    t = table(spark, sf, "customer").select("c_custkey")
    return smp.sample_n(t, 3 * t.count(), SEED, ["c_custkey"])


@query(
    "c5_split",
    f"SELECT event_id, CASE WHEN {sql.u(SEED, 'split', 'event_id')} < {sql.d(0.7)} THEN 'train' "
    "ELSE 'test' END AS part FROM events",
)
def c5(spark, sf):
    a, b = smp.bernoulli_split(table(spark, sf, "events").select("event_id"), 0.7, SEED, ["event_id"])
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query(
    "c6_folds",
    f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY {sql.u(SEED, 'fold', 'o_orderkey')}, o_orderkey)"
    " - 1) % 5 AS INTEGER) AS fold FROM orders",
)
def c6(spark, sf):
    return smp.folds(table(spark, sf, "orders").select("o_orderkey"), 5, SEED, ["o_orderkey"])


@query("c7_row_at", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42")
def c7(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return smp.row_at(t, 42, "o_orderkey")


@query(
    "c8_stratified_split",
    f"SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY "
    f"{sql.u(SEED, 'strata', 'event_id')}, event_id) - 1 < ceil({sql.d(0.8)} * count(*) OVER "
    "(PARTITION BY event_type)) AS train FROM events",
)
def c8(spark, sf):
    t = table(spark, sf, "events").select("event_id", "event_type")
    return smp.stratified_split(t, "event_type", 0.8, SEED, ["event_id"])


# ---- D: encoding and decoding ----


@query(
    "d1_label_encode",
    f"WITH lab AS ({sql.labels_sql('orders', 'o_orderpriority')}) SELECT o_orderkey, "
    "CAST(label AS INTEGER) AS o_orderpriority FROM orders JOIN lab ON value = o_orderpriority",
)
def d1(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    labels = enc.fit_labels(t, ["o_orderpriority"])
    return enc.encode_labels(t, labels, ["o_orderpriority"], ORDERS)


@query("d2_label_decode", "SELECT o_orderkey, o_orderpriority FROM orders")
def d2(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    labels = enc.fit_labels(t, ["o_orderpriority"])
    codes = enc.encode_labels(t, labels, ["o_orderpriority"], ORDERS)
    return enc.decode_labels(codes, labels, ["o_orderpriority"], ORDERS)


@query(
    "d3_ordinal_encode",
    "SELECT l_orderkey, CAST(greatest(5, least(40, l_quantity)) - 5 AS BIGINT) AS code FROM lineitem",
)
def d3(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", enc.ordinal_code(F.col("l_quantity"), 5, 40).alias("code"))


@query(
    "d4_ordinal_decode",
    "SELECT l_orderkey, CAST(greatest(5, least(40, l_quantity + 5)) AS BIGINT) AS value FROM lineitem",
)
def d4(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", enc.ordinal_value(F.col("l_quantity"), 5, 40).alias("value"))


@query(
    "d5_continuous_encode",
    f"SELECT l_orderkey, round(greatest({sql.d(0)}, least({sql.d(1)}, (l_extendedprice - {sql.d(2000)}) / "
    f"{sql.d(98000)})), 9) AS z FROM lineitem",
)
def d5(spark, sf):
    t = table(spark, sf, "lineitem")
    z = enc.unit_code(F.col("l_extendedprice"), 2000, 100000)
    return t.select("l_orderkey", F.round(z, 9).alias("z"))


@query(
    "d6_continuous_decode",
    f"SELECT l_orderkey, round(greatest({sql.d(0)}, least({sql.d(1)}, (l_extendedprice - {sql.d(2000)}) / "
    f"{sql.d(98000)})) * {sql.d(98000)} + {sql.d(2000)}, 6) AS price FROM lineitem",
)
def d6(spark, sf):
    t = table(spark, sf, "lineitem")
    z = enc.unit_code(F.col("l_extendedprice"), 2000, 100000)
    return t.select("l_orderkey", F.round(enc.unit_value(z, 2000, 100000), 6).alias("price"))


@query(
    "d7_null_indicator",
    f"WITH {DOC_SQL} SELECT doc_id, coalesce(CAST(quality AS DOUBLE), 0) AS quality, "
    "CAST(quality IS NULL AS INTEGER) AS quality_null, coalesce(CAST(toxic AS DOUBLE), 0) AS toxic, "
    "CAST(toxic IS NULL AS INTEGER) AS toxic_null FROM docs",
)
def d7(spark, sf):
    return enc.split_nulls(doc_labels(spark, sf).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@query(
    "d7_null_decode",
    f"WITH {DOC_SQL} SELECT doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM docs",
)
def d7_back(spark, sf):
    names = ["quality", "toxic"]
    return enc.join_nulls(enc.split_nulls(doc_labels(spark, sf).select("doc_id", *names), names), names)


@query(
    "d8_typed_rows",
    f"WITH {sql.encoded_ctes('orders', ORDERS, ('t.o_orderkey',))} SELECT o_orderstatus, o_orderpriority, "
    "round(o_totalprice, 9) AS o_totalprice FROM enc",
)
def d8(spark, sf):
    t = table(spark, sf, "orders")
    e = enc.encode(t, ORDERS, enc.fit_labels(t, ORDERS.of_role(CATEGORICAL), size_bound=largest(ORDERS)))
    return enc.typed(e, ORDERS).withColumn("o_totalprice", F.round("o_totalprice", 9))


@query(
    "d9_dequantise",
    f"WITH lab AS ({sql.labels_sql('orders', 'o_orderpriority')}) SELECT o_orderkey, round((label + "
    f"{sql.u(SEED, 'dequantise', chr(39) + 'o_orderpriority' + chr(39), 'o_orderkey')}) / 5, 6) AS o_orderpriority "
    "FROM orders JOIN lab ON value = o_orderpriority",
)
def d9(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    codes = enc.encode_labels(t, enc.fit_labels(t, ["o_orderpriority"]), ["o_orderpriority"], ORDERS)
    out = enc.dequantise(codes, ["o_orderpriority"], ORDERS, SEED, ["o_orderkey"])
    return out.withColumn("o_orderpriority", F.round("o_orderpriority", 6))


def _bounds_sql(cols: list[str], eps: float, beta: float = 1e-9) -> str:
    import math

    threshold = math.log(192 / (2.0 * beta)) / eps
    pairs = " UNION ALL ".join(f"SELECT '{c}' AS col, CAST({c} AS DOUBLE) AS x FROM customer" for c in cols)
    grid = " UNION ALL ".join(
        f"SELECT '{c}' AS col, {s} AS sign, unnest(range(-32, 64)) AS e" for c in cols for s in (-1, 1)
    )
    return (
        f"WITH p AS ({pairs}), b AS (SELECT col, CASE WHEN x < 0 THEN -1 ELSE 1 END AS sign, "
        f"CASE WHEN abs(x) < {sql.d(2.0**-32)} THEN -32 ELSE greatest(-32, least(63, floor(log2(abs(x))))) END AS e "
        f"FROM p WHERE x IS NOT NULL), c AS (SELECT col, sign, e, count(*) AS cnt FROM b GROUP BY ALL), "
        f"g AS ({grid}), k AS (SELECT g.* FROM g LEFT JOIN c ON c.col = g.col AND c.sign = g.sign AND c.e = g.e "
        f"WHERE coalesce(cnt, 0) + {sql.laplace(SEED, 'bounds', 'g.col', 'g.sign', 'g.e')} / {sql.d(eps)} > "
        f"{sql.d(threshold)}) SELECT col, min(CASE WHEN sign < 0 THEN -(CAST(2 AS DOUBLE)**(e + 1)) "
        f"WHEN e = -32 THEN 0 ELSE CAST(2 AS DOUBLE)**e END) AS lower, max(CASE WHEN sign < 0 THEN "
        f"CASE WHEN e = -32 THEN 0 ELSE -(CAST(2 AS DOUBLE)**e) END ELSE CAST(2 AS DOUBLE)**(e + 1) END) AS upper "
        f"FROM k GROUP BY col"
    )


@query("d10_private_bounds", _bounds_sql(["c_acctbal", "c_custkey"], 1.0))
def d10(spark, sf):
    return private_bounds(table(spark, sf, "customer"), ["c_acctbal", "c_custkey"], 1.0, SEED)
