"""Exact global positions without a one-task sort.

A bucket column that is monotone in the order splits the table. Bucket sizes are counted, summed up
(one small row per bucket) and added to the position inside the bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 200_000
MIN_BUCKETS, MAX_BUCKETS = 16, 1 << 16


def bucket_count(rows: int) -> int:
    return max(MIN_BUCKETS, min(MAX_BUCKETS, rows // ROWS_PER_BUCKET))


def hash_bucket(u: Column, buckets: int) -> Column:
    return F.floor(u * F.lit(buckets)).cast("int")


def with_position(
    df: DataFrame, order: list, bucket: Column, group: list[str] = (), out: str = "pos"
) -> DataFrame:
    """Add the 0-based position in ``order``, within ``group`` when given.

    ``bucket`` must not decrease along ``order``. The offsets table has one row per
    (group, bucket); the broadcast choice is left to Spark since groups are the caller's.
    """
    group = list(group)
    cut = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *[F.col(k).alias(f"_{k}_at") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}_at")) for k in keys])
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return (
        cut.withColumn("_local", local)
        .join(offsets, same)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_bucket", "_local", "_offset", *[f"_{k}_at" for k in keys])
    )


def with_running_sum(df: DataFrame, value: str, order: list, bucket: Column, out: str = "upto") -> DataFrame:
    """Add the sum of the whole numbers ``value`` over all rows up to and with each row, in ``order``.

    ``bucket`` must not decrease along ``order``: sums per bucket are added up first, so each bucket is
    summed by a task of its own.
    """
    cut = df.withColumn("_bucket", bucket)
    before = W.orderBy("_bucket_at").rowsBetween(W.unboundedPreceding, -1)
    sums = cut.groupBy(F.col("_bucket").alias("_bucket_at")).agg(F.sum(value).alias("_sum"))  # a row per bucket
    offsets = sums.select("_bucket_at", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    local = F.sum(value).over(W.partitionBy("_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = cut.withColumn("_local", local).join(offsets, F.col("_bucket") == F.col("_bucket_at"))
    return joined.withColumn(out, (F.col("_local") + F.col("_offset")).cast("long")).drop("_bucket", "_local", "_offset", "_bucket_at")
