"""SQL text for the oracles: the same definitions, written independently of the DataFrame code."""

from __future__ import annotations

import math
import re

from veiltab.operators.domain import CATEGORICAL, ORDINAL, Domain
from veiltab.operators.marginals import Marginals


def d(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def u(seed, tag: str, *keys: str) -> str:
    """Uniform of (seed, tag, keys); keys are SQL expressions."""
    parts = [f"'{seed}'", f"'{tag}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]
    bits = f"CAST(('0x'||substr(md5(concat_ws('|',{','.join(parts)})),1,13)) AS BIGINT)"
    return f"((CAST({bits} AS DOUBLE) + {d(0.5)}) / {d(2.0**52)})"


def gauss(seed, tag: str, *keys: str) -> str:
    u1, u2 = u(seed, tag + ".u1", *keys), u(seed, tag + ".u2", *keys)
    return f"(sqrt({d(-2.0)} * ln({u1})) * cos({d(2 * math.pi)} * {u2}))"


def gumbel(seed, tag: str, *keys: str) -> str:
    return f"(-ln(-ln({u(seed, tag, *keys)})))"


def laplace(seed, tag: str, *keys: str) -> str:
    x = f"({u(seed, tag, *keys)} - {d(0.5)})"
    return f"(-sign({x}) * ln({d(1.0)} - {d(2.0)} * abs({x})))"


def clip01(x: str) -> str:
    return f"greatest({d(0)}, least({d(1)}, {x}))"


def bin_case(x: str, edges) -> str:
    """Bin by comparing from the top; outer bins are open."""
    inner = list(edges)[1:-1]
    whens = " ".join(f"WHEN {x} >= {d(e)} THEN {i + 1}" for i, e in reversed(list(enumerate(inner))))
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} ELSE 0 END"


def materialized(text: str, *names: str) -> str:
    """The same text with the named CTEs computed once."""
    return re.sub(rf"\b({'|'.join(names)}) AS \(", r"\1 AS MATERIALIZED (", text)


def labels_sql(source: str, col: str) -> str:
    return (
        f"SELECT value, row_number() OVER (ORDER BY value) - 1 AS label FROM "
        f"(SELECT DISTINCT CAST({col} AS VARCHAR) AS value FROM {source} WHERE {col} IS NOT NULL)"
    )


def encoded_ctes(source: str, domain: Domain, extra: tuple[str, ...] = (), name: str = "enc") -> str:
    """CTEs ending in ``name``: the encoded table plus ``extra`` columns."""
    ctes, joins, cols = [], [], list(extra)
    for c in domain.columns:
        n, lo, hi = c.name, d(c.lo), d(c.hi)
        if c.role == CATEGORICAL:
            ctes.append(f"lab_{n} AS ({labels_sql(source, n)})")
            joins.append(f"LEFT JOIN lab_{n} ON lab_{n}.value = CAST(t.{n} AS VARCHAR)")
            cols.append(f"CAST(lab_{n}.label AS INTEGER) AS {n}")
        elif c.role == ORDINAL:
            x = f"greatest({lo}, least({hi}, CAST(t.{n} AS DOUBLE))) - {lo}"
            cols.append(f"CASE WHEN t.{n} IS NOT NULL THEN CAST({x} AS BIGINT) END AS {n}")
        else:
            x = f"greatest({d(0)}, least({d(1)}, (t.{n} - {lo}) / {d(c.hi - c.lo)})) + {d(0)}"
            cols.append(f"CASE WHEN t.{n} IS NOT NULL THEN {x} END AS {n}")
    ctes.append(f"{name} AS (SELECT {', '.join(cols)} FROM {source} t {' '.join(joins)})")
    return ", ".join(ctes)


def finest_sql(domain: Domain, name: str, depth: int) -> str:
    c = domain[name]
    if c.role == CATEGORICAL:
        b = name
    elif c.role == ORDINAL and c.edges is None:
        b = f"least({c.size - 1}, greatest(0, {name}))"
    else:
        b = bin_case(name, c.bin_edges(depth))
    if c.has_nulls:
        b = f"CASE WHEN {name} IS NULL THEN {c.finest(depth)} ELSE {b} END"
    return b


def binned_cte(domain: Domain, depth: int, source: str = "enc", name: str = "binned", extra: str = "") -> str:
    cols = ", ".join(f"{finest_sql(domain, n, depth)} AS b_{n}" for n in domain.names)
    return f"{name} AS (SELECT {extra}{cols} FROM {source})"


def cell_sql(m: Marginals, w, prefix: str = "b_") -> str:
    """Row-major cell number of a workload from finest bins."""
    expr = "0"
    for col, dim in zip(w.cols, w.dims):
        b = f"{prefix}{col}"
        lvl = f"least({b} // {dim.stride}, {dim.n - 1})"
        if dim.nullable:
            lvl = f"CASE WHEN {b} = {dim.n0} THEN {dim.n} ELSE {lvl} END"
        expr = f"({expr}) * {dim.width} + ({lvl})"
    return expr


def counts_cte(m: Marginals, name: str = "cnts", source: str = "binned", only: list[int] | None = None) -> str:
    """Non-empty cells, one GROUP BY per workload."""
    parts = []
    for w in m.workloads:
        if only is not None and w.workload_id not in only:
            continue
        cell = cell_sql(m, w)
        parts.append(
            f"SELECT {w.workload_id} AS workload_id, {cell} AS cell, count(*) AS cnt FROM {source} "
            f"WHERE {cell} IS NOT NULL GROUP BY {cell}"
        )
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def grid_cte(m: Marginals, name: str = "grid", only: list[int] | None = None) -> str:
    parts = [
        f"SELECT {w.workload_id} AS workload_id, unnest(range({w.n_cells})) AS cell"
        for w in m.workloads
        if only is None or w.workload_id in only
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def dense_cte(m: Marginals, rows: str, name: str = "dense", only: list[int] | None = None) -> str:
    """grid + counts -> (workload_id, cell, cnt, stat)."""
    return (
        f"{grid_cte(m, 'grid_' + name, only)}, {counts_cte(m, 'cnts_' + name, only=only)}, "
        f"{name} AS (SELECT g.workload_id, g.cell, coalesce(c.cnt, 0) AS cnt, "
        f"coalesce(c.cnt, 0) / CAST(({rows}) AS DOUBLE) AS stat FROM grid_{name} g "
        f"LEFT JOIN cnts_{name} c USING (workload_id, cell))"
    )


def noisy_cte(rho_each: float, rows: str, seed, run: str, round_no: int, source: str, name: str = "meas", module: str = "marginals") -> str:
    """dense -> noised, sigma = sqrt(2) / N / sqrt(2 rho)."""
    sigma = f"({d(math.sqrt(2.0))} / CAST(({rows}) AS DOUBLE) / {d(math.sqrt(2.0 * rho_each))})"
    noise = gauss(seed, "measure", f"'{run}'", str(round_no), f"'{module}'", "workload_id", "cell")
    return (
        f"{name} AS (SELECT workload_id, cell, stat, {clip01(f'stat + {sigma} * {noise}')} AS noised, "
        f"{sigma} AS sigma FROM {source})"
    )
