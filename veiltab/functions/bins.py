"""Bin numbers from edge lists.

``Bucketizer`` runs a binary search per value. Nested CASE expressions with 63 edges on a handful of
columns grow past the size the JVM compiles and measured about eight times slower.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.operators.domain import CATEGORICAL, ORDINAL, Domain

INF = float("inf")


def add_bins(df: DataFrame, edges: dict[str, tuple[str, list[float]]], outside: bool = False) -> DataFrame:
    """Add ``{out: (column, edges)}`` bin numbers 0..n-1, NULL for NULL.

    Intervals are [a, b); the outer ones reach to infinity, so the top value belongs to the last bin.
    With ``outside`` the two outer intervals get numbers of their own (-1 and n).
    """
    many = {}
    for out, (col, e) in edges.items():
        inner = list(e) if outside else list(e)[1:-1]
        if not inner:
            df = df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0)))
        else:
            many[out] = (col, [-INF, *inner, INF])
    if not many:
        return df
    df = df.withColumns({f"_x_{o}": F.col(c).cast("double") for o, (c, _) in many.items()})
    df = Bucketizer(
        splitsArray=[e for _, e in many.values()],
        inputCols=[f"_x_{o}" for o in many],
        outputCols=[f"_b_{o}" for o in many],
        handleInvalid="keep",
    ).transform(df)
    shift = 1 if outside else 0
    df = df.withColumns({o: F.col(f"_b_{o}").cast("int") - shift for o in many})
    return df.drop(*[f"_{t}_{o}" for o in many for t in "xb"])


def bin_table(df: DataFrame, domain: Domain, depth: int, names: list[str] | None = None, prefix: str = "b_") -> DataFrame:
    """Finest bin of every column as ``b_<name>``; the null bin is number n of a nullable column.

    A NULL in a column without a null bin stays NULL: the row is in no cell of that column. So does a
    label outside 0..size-1, with or without a null bin.
    """
    names = names or domain.names
    edges, direct = {}, {}
    for n in names:
        c = domain[n]
        if c.role == CATEGORICAL:
            direct[prefix + n] = F.when(F.col(n).between(0, c.size - 1), F.col(n).cast("int"))
        elif c.role == ORDINAL and c.edges is None:
            top = F.lit(c.size - 1)
            code = F.greatest(F.lit(0), F.least(top, F.floor(F.col(n)).cast("int")))
            direct[prefix + n] = F.when(F.col(n).isNotNull(), code)
        else:
            edges[prefix + n] = (n, c.bin_edges(depth))
    if direct:
        df = df.withColumns(direct)
    df = add_bins(df, edges)
    nulls = {
        prefix + n: F.when(F.col(n).isNull(), F.lit(domain[n].finest(depth))).otherwise(F.col(prefix + n))
        for n in names
        if domain[n].has_nulls
    }
    return df.withColumns(nulls) if nulls else df
