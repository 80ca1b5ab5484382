"""Projection, hash sampling and splitting. Every choice is a function of (seed, row key)."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.functions.hashing import uniform
from veiltab.functions.ranking import bucket_count, hash_bucket, with_position
from veiltab.operators.domain import Domain, check_columns


def project(df: DataFrame, domain: Domain, names) -> tuple[DataFrame, Domain]:
    part = domain.project(names)
    check_columns(df, part.names)
    return df.select(*part.names), part


def drop(df: DataFrame, domain: Domain, names) -> tuple[DataFrame, Domain]:
    names = [names] if isinstance(names, str) else names
    return project(df, domain, domain.complement(names))


def _u(seed, tag: str, key: list[str]) -> C:
    return uniform(seed, tag, *[F.col(k) for k in key])


def sample_fraction(df: DataFrame, p: float, seed, key: list[str], replace: bool = False) -> DataFrame:
    """Without replacement: a filter, no shuffle. With replacement each row comes as often as a Poisson
    count with mean p says, which is read off the row's hash; so partitions don't matter."""
    u = _u(seed, "sample", key)
    if not replace:
        return df.where(u < F.lit(p))
    limits = poisson_limits(p)
    times = sum((F.when(F.col("_u") >= F.lit(x), 1).otherwise(0) for x in limits), F.lit(0))
    counted = df.withColumn("_u", u).withColumn("_times", times).where("_times > 0")
    return counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_u", "_times", "_copy")


def poisson_limits(p: float, tail: float = 2.0**-52) -> list[float]:
    """P(count <= k) for k = 0, 1, ... until the rest is below what a hash can tell apart."""
    out, term, total, k = [], math.exp(-p), math.exp(-p), 0
    while 1.0 - total > tail and k < 1000:
        out.append(total)
        k += 1
        term *= p / k
        total += term
    return out


def shuffled(df: DataFrame, seed, tag: str, key: list[str], rows: int, out: str = "pos", group=()) -> DataFrame:
    """Position of every row in a hash-shuffled order, by evenly filled hash buckets."""
    buckets = bucket_count(rows)
    df = df.withColumn("_u", _u(seed, tag, key))
    order = ["_u", *key]
    return with_position(df, order, hash_bucket(F.col("_u"), buckets), group, out).drop("_u")


def sample_n(df: DataFrame, n: int, seed, key: list[str], replace: bool | None = None) -> DataFrame:
    """Exactly n rows; repeats are allowed when n exceeds the table or on request. Without repeats and
    with n beyond the table these are all its rows.

    Without repeats these are the n smallest hashes. Bucket sizes tell in which hash bucket the n-th
    one lies: rows below it are kept by a filter alone, and only that bucket is sorted.
    """
    rows = df.count()
    if replace is None:
        replace = n > rows
    if not replace and n >= rows:
        return df
    if not replace:
        hashed = df.withColumn("_u", _u(seed, "sample_n", key))
        bucket = hash_bucket(F.col("_u"), bucket_count(rows))
        counts = hashed.groupBy(bucket.alias("b")).count().collect()  # at most MAX_BUCKETS numbers
        left, last = n, 0
        for last, size in sorted((r["b"], r["count"]) for r in counts):
            if size >= left:
                break
            left -= size
        below = hashed.where(bucket < last)
        rest = hashed.where(bucket == last).orderBy("_u", *key).limit(left)
        return below.unionByName(rest).drop("_u")
    # Draws are counted per position first: a row drawn often is one row with a count.
    placed = shuffled(df, seed, "sample_n", key, rows)
    draw = F.floor(uniform(seed, "draw", F.col("id")) * F.lit(rows)).cast("long")
    draws = df.sparkSession.range(n).groupBy(draw.alias("pos")).agg(F.count(F.lit(1)).alias("_times"))
    return (
        placed.join(draws, "pos")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
        .drop("pos", "_times", "_copy")
    )


def systematic_copies(rows: int, n: int, offset: int) -> tuple[C, C]:
    """First new position and number of copies of the row at position ``_at`` when ``rows`` rows become ``n``.

    The copies of all rows are consecutive numbers from 0 to n - 1, and two rows differ by one copy at most.
    """
    if rows * (n + 1) >= 1 << 63:
        raise ValueError(f"{rows} rows times {n} do not fit a long")
    first = F.expr(f"(_at * {n}L + {offset}L) div {rows}L")
    return first, F.expr(f"((_at + 1L) * {n}L + {offset}L) div {rows}L") - first


def resample(df: DataFrame, n: int, seed, key: list[str], out: str = "row_id", rows: int | None = None) -> DataFrame:
    """Exactly n rows by systematic resampling, with new ids 0..n-1 in ``out``; ``_copy`` numbers a row's copies from 0.

    Rows are taken in hash order, by one running position over evenly filled hash buckets; every row comes
    floor(n / rows) or one more times, so shares move by less than 1 / n each. An empty table cannot be resampled.
    """
    rows = df.count() if rows is None else rows
    if not rows:
        raise ValueError("an empty table cannot be resampled")
    placed = shuffled(df, seed, "resample", key, rows, out="_at")
    return spread(placed, rows, n, start_of(seed, rows), out)


def start_of(seed, rows: int) -> int:
    """Where the systematic sample begins, a whole number below ``rows``."""
    return int(hashlib.md5(f"{seed}|resample.start".encode()).hexdigest()[:13], 16) * rows >> 52


def spread(placed: DataFrame, rows: int, n: int, offset: int, out: str = "row_id") -> DataFrame:
    """``resample`` of rows whose positions 0..rows-1 are in ``_at``."""
    first, times = systematic_copies(rows, n, offset)
    counted = placed.withColumn("_first", first).withColumn("_times", times.cast("int")).where("_times > 0")
    copies = counted.withColumn("_copy", F.explode(F.expr("sequence(0, _times - 1)")))
    return copies.withColumn(out, F.col("_first") + F.col("_copy")).drop("_at", "_first", "_times")


def bernoulli_split(df: DataFrame, p: float, seed, key: list[str]) -> tuple[DataFrame, DataFrame]:
    u = _u(seed, "split", key)
    return df.where(u < F.lit(p)), df.where(u >= F.lit(p))


def folds(df: DataFrame, k: int, seed, key: list[str], rows: int | None = None) -> DataFrame:
    """k folds whose sizes differ by at most one."""
    rows = df.count() if rows is None else rows
    placed = shuffled(df, seed, "fold", key, rows)
    return placed.withColumn("fold", (F.col("pos") % k).cast("int")).drop("pos")


def row_at(df: DataFrame, position: int, id_column: str = "row_id") -> DataFrame:
    """One row of a table that carries row ids; the filter reaches the scan."""
    return df.where(F.col(id_column) == position)


def stratified_split(
    df: DataFrame, label: str, p: float, seed, key: list[str], rows: int | None = None
) -> DataFrame:
    """Mark ceil(p * count) rows of every label as train.

    The hash buckets cut every label, so a label with a third of the table is ranked by many tasks.
    """
    rows = df.count() if rows is None else rows
    placed = shuffled(df, seed, "strata", key, rows, group=[label])
    sizes = df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_size"))
    train = F.col("pos") < F.ceil(F.lit(p) * F.col("_size"))
    same = F.col(label).eqNullSafe(F.col("_label"))
    return placed.join(sizes, same).withColumn("train", train).drop("pos", "_size", "_label")
