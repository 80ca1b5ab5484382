"""Encoding to labels, shifted integers and [0,1], and back."""

from __future__ import annotations

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veiltab.functions.literals import small_table
from veiltab.functions.hashing import uniform
from veiltab.operators.domain import (
    CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, check_columns, clean_nan, label_table,
)
from veiltab.functions.ranking import with_position
from veiltab.session import Workspace, lookup

ONE_TASK_LABELS = 1_000_000


def fit_labels(
    df: DataFrame, names: list[str], public: dict[str, list] | None = None, size_bound: int | None = None
) -> DataFrame:
    """Dense labels 0..n-1 in value order.

    Labels learned from the table reveal which values occur; a public value list does not. With a
    known ``size_bound`` per column that fits one task's sort, the distinct values are ranked by one
    window. Otherwise they are range-partitioned and written, and ranked partition by partition.
    """
    public = public or {}
    found = label_table(df, [n for n in names if n not in public])
    if public:
        rows = [(n, str(v)) for n, vs in public.items() for v in sorted(set(map(str, vs)))]
        found = found.unionByName(
            small_table(df.sparkSession, rows, "col string, value string")
        )
    if size_bound is not None and size_bound <= ONE_TASK_LABELS:
        rank = F.row_number().over(W.partitionBy("col").orderBy("value")) - 1
        return found.select("col", "value", rank.cast("int").alias("label"))
    parted = found.repartitionByRange("col", "value").withColumn("_part", F.spark_partition_id())
    parted = Workspace(df.sparkSession, "labels").write(parted, "values")  # fixes the partition numbers
    placed = with_position(parted, ["value"], F.col("_part"), ["col"], "label")
    return placed.select("col", "value", F.col("label").cast("int").alias("label"))


def encode_labels(df: DataFrame, labels: DataFrame, names: list[str], domain: Domain) -> DataFrame:
    """Values outside the label list become NULL."""
    for n in names:
        # labels beyond the declared size are left out, so the size does bound what is broadcast
        one = labels.where((F.col("col") == n) & (F.col("label") < domain[n].size)).select(
            F.col("value").alias("_value"), F.col("label").alias("_label")
        )
        df = lookup(
            df.withColumn("_value", F.col(n).cast("string")), one, ["_value"], domain[n].size
        ).withColumn(n, F.col("_label")).drop("_value", "_label")
    return df


def decode_labels(df: DataFrame, labels: DataFrame, names: list[str], domain: Domain) -> DataFrame:
    for n in names:
        one = labels.where((F.col("col") == n) & (F.col("label") < domain[n].size)).select(
            F.col("label").alias("_label"), F.col("value").alias("_value")
        )
        df = lookup(
            df.withColumn("_label", F.col(n).cast("int")), one, ["_label"], domain[n].size
        ).withColumn(n, F.col("_value")).drop("_value", "_label")
    return df


def _clamp(x: C, lo: float, hi: float) -> C:
    """greatest/least skip NULLs, so the NULL is put back."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def ordinal_code(x: C, lo: float, hi: float) -> C:
    return (_clamp(x.cast("double"), float(lo), float(hi)) - F.lit(float(lo))).cast("long")


def ordinal_value(code: C, lo: float, hi: float) -> C:
    return _clamp(code.cast("double") + F.lit(float(lo)), float(lo), float(hi)).cast("long")


def unit_code(x: C, lo: float, hi: float) -> C:
    """Min-max to [0,1]; a single-valued range maps to 0."""
    if hi <= lo:
        return F.when(x.isNotNull(), F.lit(0.0))
    z = (x.cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo))
    return _clamp(z, 0.0, 1.0)


def unit_value(code: C, lo: float, hi: float) -> C:
    return code * F.lit(float(hi - lo)) + F.lit(float(lo))


def numeric_code(col: Column, x: C) -> C:
    return (ordinal_code if col.role == ORDINAL else unit_code)(x, col.lo, col.hi)


def encode(
    df: DataFrame, domain: Domain, labels: DataFrame | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Typed encoded table with the domain's columns (and ``keep``) only. NaN is NULL."""
    check_columns(df, domain.names)
    df = clean_nan(df.select(*keep, *domain.names))
    cats = domain.of_role(CATEGORICAL)
    if cats:
        df = encode_labels(df, labels, cats, domain)
    return df.select(
        *keep,
        *[
            F.col(c.name) if c.role == CATEGORICAL else numeric_code(c, F.col(c.name)).alias(c.name)
            for c in domain.columns
        ]
    )


def typed(df: DataFrame, domain: Domain) -> DataFrame:
    """Domain order; whole numbers for labels and ordinals, doubles for continuous columns."""
    kinds = {CATEGORICAL: "int", ORDINAL: "long", CONTINUOUS: "double"}
    return df.select(*[F.col(c.name).cast(kinds[c.role]).alias(c.name) for c in domain.columns])


def decode(df: DataFrame, domain: Domain, labels: DataFrame | None = None) -> DataFrame:
    df = typed(df, domain)
    cats = domain.of_role(CATEGORICAL)
    if cats and labels is not None:
        df = decode_labels(df, labels, cats, domain)
    out = []
    for c in domain.columns:
        x = F.col(c.name)
        if c.role == ORDINAL:
            x = ordinal_value(x, c.lo, c.hi)
        elif c.role == CONTINUOUS:
            x = unit_value(x, c.lo, c.hi)
        out.append(x.alias(c.name))
    return df.select(*out)


def split_nulls(df: DataFrame, names: list[str]) -> DataFrame:
    """Each column becomes (value or 0, 1 if it was null)."""
    out = []
    for n in df.columns:
        if n not in names:
            out.append(F.col(n))
            continue
        out += [
            F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n),
            F.col(n).isNull().cast("int").alias(f"{n}_null"),
        ]
    return df.select(*out)


def join_nulls(df: DataFrame, names: list[str]) -> DataFrame:
    flags = {f"{n}_null" for n in names}
    return df.select(
        *[
            F.when(F.col(f"{n}_null") == 0, F.col(n)).alias(n) if n in names else F.col(n)
            for n in df.columns
            if n not in flags
        ]
    )


def dequantise(df: DataFrame, names: list[str], domain: Domain, seed, key: list[str]) -> DataFrame:
    """Spread a code evenly inside its cell of [0,1]: (code + U) / size."""
    spread = {
        n: (F.col(n) + uniform(seed, "dequantise", n, *[F.col(k) for k in key])) / domain[n].size
        for n in names
    }
    return df.select(*[spread[n].alias(n) if n in spread else F.col(n) for n in df.columns])
