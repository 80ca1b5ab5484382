"""Run registered queries beside their SQL and compare rows: ``check_oracles.py [sf_dir] [name...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark_df, con, sql: str) -> tuple[str | None, int]:
    """(what differs or None, rows)."""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(cols)}", 0
    kinds = {c[0]: str(c[1]).upper() for c in cur.description}
    for name, kind in spark_df.dtypes:
        if SAME.get(kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}", 0
    order = sorted(cols)
    at = [cols.index(c) for c in order]
    want = sorted((repr(tuple(normal(r[i]) for i in at)) for r in cur.fetchall()))
    got = sorted(repr(tuple(normal(r[c]) for c in order)) for r in spark_df.collect())
    if want == got:
        return None, len(got)
    diff = [(g, w) for g, w in zip(got, want) if g != w][:3]
    return f"rows {len(got)} vs {len(want)}; first differences {diff}", len(got)


def main() -> int:
    from veiltab.plans.catalog import ORACLES, QUERIES
    from veiltab.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    names = [n for n in QUERIES if any(n == x or n.startswith(x) for x in names)]
    spark, con, bad = local_session(8), connect(sf_dir), 0
    for n in names:
        start = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            if n in ORACLES:
                problem, rows = compare(df, con, ORACLES[n])
                state = f"ok {rows}" if problem is None else f"DIFF {problem[:1500]}"
            else:
                problem, rows = None, df.count()
                state = f"rows={rows}"
        except Exception as e:  # noqa: BLE001
            problem, state = str(e), f"ERROR {type(e).__name__} {str(e)[:1500]}"
        bad += problem is not None
        print(f"{n:36s} {time.time() - start:6.2f}s {state}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main()))
