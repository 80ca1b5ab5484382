"""Column roles, sizes, ranges and bin edges: the only metadata the driver holds."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veiltab.functions.literals import small_table

CATEGORICAL, ORDINAL, CONTINUOUS = "categorical", "ordinal", "continuous"
# The type names accepted in meta_data for each role.
ROLE_NAMES = {
    "string": CATEGORICAL,
    "categorical": CATEGORICAL,
    "int": ORDINAL,
    "ordinal": ORDINAL,
    "float": CONTINUOUS,
    "continuous": CONTINUOUS,
}


def linspace(lo: float, hi: float, n: int) -> tuple[float, ...]:
    if n == 1:
        return (float(lo),)
    return tuple(lo + i * ((hi - lo) / (n - 1)) for i in range(n - 1)) + (float(hi),)


@dataclass(frozen=True)
class Column:
    """One attribute. ``lo``/``hi`` are bounds in the original units; ``edges`` are in encoded units."""

    name: str
    role: str
    size: int = 1
    lo: float = 0.0
    hi: float = 1.0
    has_nulls: bool = False
    sparse: bool = False
    edges: tuple[float, ...] | None = None

    @property
    def numeric(self) -> bool:
        return self.role != CATEGORICAL

    @property
    def range(self) -> tuple[float, float]:
        return (0.0, 1.0) if self.role == CONTINUOUS else (0.0, float(self.size))

    def bin_edges(self, depth: int) -> tuple[float, ...]:
        """Edges in force: the given ones, 2^depth even points, or one per ordinal value."""
        if self.edges is not None:
            return self.edges
        if self.role == CONTINUOUS:
            return linspace(0.0, 1.0, 2**depth)
        return tuple(float(i) for i in range(self.size + 1))

    def n_edges(self, depth: int) -> int:
        """Number of ``bin_edges``, without building them."""
        if self.edges is not None:
            return len(self.edges)
        return 2**depth if self.role == CONTINUOUS else self.size + 1

    def finest(self, depth: int) -> int:
        return self.n_edges(depth) - 1 if self.numeric else self.size

    def coarse(self, depth: int, level: int) -> tuple[int, int]:
        """(stride over finest bins, number of bins) at a level; categories are never merged."""
        if not self.numeric:
            return 1, self.size
        n_edges = self.n_edges(depth)
        stride = 2**level
        if n_edges // stride < 3:
            stride = max(1, n_edges // 2)
        return stride, max(1, -(-(n_edges - stride) // stride))

    @property
    def weight(self) -> int:
        return int(math.log(len(self.edges) if self.edges is not None else max(self.size, 1)) + 1)


@dataclass(frozen=True)
class Domain:
    columns: tuple[Column, ...]

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def __getitem__(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def position(self, name: str) -> int:
        return self.names.index(name)

    def of_role(self, *roles: str) -> list[str]:
        return [c.name for c in self.columns if c.role in roles]

    def project(self, names: Iterable[str] | str) -> Domain:
        names = [names] if isinstance(names, str) else names
        return Domain(tuple(self[n] for n in names))

    def complement(self, names: Iterable[str]) -> list[str]:
        drop = set(names)
        return [n for n in self.names if n not in drop]

    def contains(self, other: Domain) -> bool:
        return set(other.names) <= set(self.names)

    def with_edges(self, edges: dict[str, Iterable[float]]) -> Domain:
        cols = [
            replace(c, edges=tuple(sorted(set(map(float, edges[c.name]))))) if c.name in edges else c
            for c in self.columns
        ]
        return Domain(tuple(cols))

    def frame(self, spark: SparkSession) -> DataFrame:
        schema = (
            "col string, pos int, role string, size long, lo double, hi double, "
            "has_nulls boolean, edges array<double>"
        )
        rows = [
            (c.name, i, c.role, c.size, float(c.lo), float(c.hi), c.has_nulls,
             None if c.edges is None else list(c.edges))
            for i, c in enumerate(self.columns)
        ]
        return small_table(spark, rows, schema)


def check_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"table lacks domain columns: {missing}")


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN compares greater than every number in Spark, so it becomes NULL on the way in."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c)
            for c in df.columns
        ]
    )


def resolve_roles(
    df: DataFrame,
    meta_data: dict | None = None,
    categorical: Iterable[str] = (),
    ordinal: Iterable[str] = (),
    continuous: Iterable[str] = (),
    max_labels: int = 50,
) -> dict[str, str]:
    """Roles from meta_data, then from the lists, and only if neither says anything from the data."""
    roles: dict[str, str] = {}
    for names, role in ((categorical, CATEGORICAL), (ordinal, ORDINAL), (continuous, CONTINUOUS)):
        for n in names or ():
            roles[n] = role
    for n in df.columns:
        kind = (meta_data or {}).get(n, {}).get("type")
        if kind is not None:
            roles[n] = ROLE_NAMES[kind]
    if not roles:
        roles = infer_roles(df, max_labels)
    if set(roles) != set(df.columns):
        raise ValueError("column mismatch: every column needs a role")
    return {n: roles[n] for n in df.columns}


def column_profile(df: DataFrame) -> DataFrame:
    """One pass over the table: distinct estimate, null count and fractional values per column."""
    df = clean_nan(df)
    rows = []
    for f in df.schema:
        c = F.col(f.name)
        floating = isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType))
        fractional = F.count_if(c != F.floor(c)) if floating else F.count_if(F.lit(False))
        rows.append(
            F.struct(
                F.lit(f.name).alias("col"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.approx_count_distinct(c).alias("n_distinct"),
                F.count_if(c.isNull()).alias("n_null"),
                fractional.cast("long").alias("n_fractional"),
            )
        )
    return df.agg(F.array(*rows).alias("p")).select(F.inline("p"))


def role_table(df: DataFrame, max_labels: int = 50) -> DataFrame:
    """Strings and booleans are categories; whole numbers with few values too, else ordinal."""
    named = F.col("dtype").isin("string", "boolean", "date", "timestamp")
    role = (
        F.when(named, F.lit(CATEGORICAL))
        .when(F.col("n_fractional") > 0, F.lit(CONTINUOUS))
        .when(F.col("n_distinct") <= max_labels, F.lit(CATEGORICAL))
        .otherwise(F.lit(ORDINAL))
    )
    return column_profile(df).withColumn("role", role)


def infer_roles(df: DataFrame, max_labels: int = 50) -> dict[str, str]:
    return {r["col"]: r["role"] for r in role_table(df, max_labels).collect()}  # one row per column


def label_table(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, value) of every distinct category, counted on the map side first."""
    if not names:
        return small_table(df.sparkSession, [], "col string, value string")
    pairs = F.array(
        *[F.struct(F.lit(n).alias("col"), F.col(n).cast("string").alias("value")) for n in names]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("value is not null").distinct()


def fit_domain(
    df: DataFrame,
    roles: dict[str, str],
    bounds: dict[str, tuple[float, float]] | None = None,
    sizes: dict[str, int] | None = None,
    nullable: Iterable[str] | None = (),
    sparse: Iterable[str] = (),
) -> Domain:
    """Sizes and ranges. Only bounds that are not given are read from the table, in one pass each.

    Bounds and label counts read from the data are not private; give them to keep the guarantee.
    ``nullable=None`` marks the columns in which the table has nulls.
    """
    bounds, sizes = bounds or {}, sizes or {}
    check_columns(df, roles)
    open_cols = [n for n, r in roles.items() if r != CATEGORICAL and n not in bounds]
    aggs = [f(F.col(n).cast("double")).alias(f"{a}_{n}") for n in open_cols
            for a, f in (("lo", F.min), ("hi", F.max))]
    if nullable is None:
        aggs += [F.count_if(F.col(n).isNull()).alias(f"null_{n}") for n in roles]
    found = clean_nan(df.select(*roles)).agg(*aggs).first().asDict() if aggs else {}
    cats = [n for n, r in roles.items() if r == CATEGORICAL and n not in sizes]
    counted = {}
    if cats:
        counted = {r["col"]: r["count"] for r in label_table(df, cats).groupBy("col").count().collect()}
    columns = []
    for n, role in roles.items():
        nulls = found.get(f"null_{n}", 0) > 0 if nullable is None else n in nullable
        if role == CATEGORICAL:
            size = sizes.get(n, counted.get(n, 1))
            columns.append(Column(n, role, size, 0.0, float(size), nulls, n in sparse))
            continue
        lo, hi = bounds.get(n, (found.get(f"lo_{n}"), found.get(f"hi_{n}")))
        lo, hi = (0.0, 0.0) if lo is None else (float(lo), float(hi))
        size = int(hi - lo) + 1 if role == ORDINAL else 1
        columns.append(Column(n, role, size, lo, hi, nulls, n in sparse))
    return Domain(tuple(columns))


def column_weights(domain: Domain, spark: SparkSession) -> DataFrame:
    """How often a column is edited: floor(ln(number of edges, or size) + 1)."""
    d = domain.frame(spark)
    size = F.greatest(F.col("size"), F.lit(1))
    n = F.when(F.col("edges").isNotNull(), F.size("edges")).otherwise(size)
    return d.select("col", "pos", F.floor(F.ln(n.cast("double")) + 1).cast("long").alias("weight"))
