"""Private measurement, selection and trimming of statistics.

All tables are keyed by (module, workload_id, cell). Noise keys carry the run, the round and the
cell, so two releases never share noise unless they share seed, run and round.
"""

from __future__ import annotations

import math

from pyspark.sql import Column as C
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veiltab.functions.hashing import gaussian, gumbel, uniform
from veiltab.functions.ranking import with_position
from veiltab.operators.histograms import clip01
from veiltab.operators.modules import Chain
from veiltab.session import BROADCAST_BYTES, small_side

KEY = ["module", "workload_id", "cell"]
WORKLOAD = ["module", "workload_id"]


def workload_budget(frame: DataFrame, rho: float, n_workloads: int, n_rows: int) -> DataFrame:
    """rho and sigma of every workload: rho split evenly, sigma = sensitivity / sqrt(2 rho) / N."""
    each = rho / n_workloads
    sigma = F.col("sensitivity") / F.lit(float(n_rows)) / F.lit(math.sqrt(2.0 * each))
    return frame.withColumn("rho", F.lit(each)).withColumn("sigma", sigma)


def add_noise(stats: DataFrame, budget: DataFrame, n_workloads: int, seed, run: str, round_no: int) -> DataFrame:
    """Measurement table from dense statistics."""
    b = small_side(budget.select(*WORKLOAD, "rho", "sigma"), n_workloads)
    noise = gaussian(
        seed, "measure", run, round_no, F.col("module"), F.col("workload_id"), F.col("cell")
    )
    noised = clip01(F.col("stat") + F.col("sigma") * noise)
    return stats.join(b, WORKLOAD).select(
        *KEY, noised.alias("noised"), "sigma", "rho", F.lit(round_no).alias("round")
    )


def measure_all(
    chain: Chain, encoded: DataFrame, n_rows: int, rho: float, seed, run: str = "run", round_no: int = 0,
    modules: list[str] | None = None,
) -> DataFrame:
    """Every workload of the chosen modules, each with an even share of rho."""
    spark = encoded.sparkSession
    pick = list(chain.modules) if modules is None else modules
    part = Chain([chain.modules[n] for n in pick])
    budget = workload_budget(part.frame(spark), rho, part.n_workloads, n_rows)
    return add_noise(part.stats(encoded, n_rows), budget, part.n_workloads, seed, run, round_no)


def workload_errors(real: DataFrame, other: DataFrame) -> DataFrame:
    """(module, workload_id, max_error): largest absolute difference of two statistics tables.

    Cells missing on one side count as zero.
    """
    a = real.select(*KEY, F.col("stat").alias("a"))
    b = other.select(*KEY, F.col("stat").alias("b"))
    gap = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return a.join(b, KEY, "full").groupBy(*WORKLOAD).agg(F.max(gap).alias("max_error"))


def select_worst(
    errors: DataFrame, k: int, rho: float, n_rows: int, seed, run: str = "run", round_no: int = 0,
    selected: DataFrame | None = None,
) -> DataFrame:
    """The k workloads with the largest noisy error (one-shot top-k with Gumbel noise)."""
    if selected is not None:
        errors = errors.join(selected.select(*WORKLOAD).distinct(), WORKLOAD, "left_anti")
    scale = math.sqrt(k) / (math.sqrt(2.0 * rho) * n_rows)
    noise = F.lit(scale) * gumbel(seed, "select", run, round_no, F.col("module"), F.col("workload_id"))
    scored = errors.withColumn("score", F.col("max_error") + noise)
    return scored.orderBy(F.desc("score"), *WORKLOAD).limit(k)


def select_and_measure(
    chain: Chain, encoded: DataFrame, real: DataFrame, synthetic: DataFrame, n_rows: int, rho: float,
    k: int, seed, run: str, round_no: int, selected: DataFrame | None = None,
) -> DataFrame:
    """One adaptive round: half of rho picks k workloads, half measures them."""
    half = rho / 2.0
    errors = workload_errors(real, synthetic)
    picks = select_worst(errors, k, half, n_rows, seed, run, round_no, selected).select(*WORKLOAD)
    frame = chain.frame(encoded.sparkSession).join(F.broadcast(picks), WORKLOAD)
    budget = workload_budget(frame, half, k, n_rows)
    part = real.join(F.broadcast(picks), WORKLOAD, "left_semi")
    return add_noise(part, budget, k, seed, run, round_no)


def exponential_choice(
    scores: DataFrame, epsilon: float, sensitivity: float, seed, key: list[str], run: str = "run", round_no: int = 0
) -> DataFrame:
    """One row, drawn with probability proportional to exp(epsilon * score / sensitivity).

    Two choices are independent if they differ in seed, run or round.

    The candidates are workloads, whose number is metadata-sized, so one ordered sum is enough.
    """
    everything = W.partitionBy(F.lit(1))
    scaled = F.lit(epsilon / sensitivity) * (F.col("score") - F.max("score").over(everything))
    w = scores.withColumn("_w", F.exp(scaled))
    order = W.partitionBy(F.lit(1)).orderBy(*key)
    w = w.withColumn("_cum", F.sum("_w").over(order.rowsBetween(W.unboundedPreceding, 0)))
    w = w.withColumn("_cum", F.col("_cum") / F.max("_cum").over(everything))
    return w.where(F.col("_cum") >= uniform(seed, "choice", run, round_no)).orderBy("_cum").limit(1).drop("_w", "_cum")


def trim(measurement: DataFrame, keep: int, max_cells: int) -> DataFrame:
    """The ``keep`` largest noisy cells of every workload, ties broken by cell.

    ``max_cells`` is the largest workload's size. A workload that fits one task's sort is ranked by
    one window; larger ones are cut into value buckets that are ranked side by side.
    """
    if keep >= max_cells:
        return measurement
    order = [F.desc("noised"), "cell"]
    if max_cells * 64 <= BROADCAST_BYTES:
        rank = F.row_number().over(W.partitionBy(*WORKLOAD).orderBy(*order))
        return measurement.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
    # Values are in [0,1] and many are exactly 0 or 1, so equal values are cut by cell number.
    blocks = max_cells // 65_536 + 1
    noised, block = F.col("noised"), F.floor(F.col("cell") / F.lit(65_536))
    between = (F.floor((F.lit(1.0) - noised) * F.lit(4096.0)) + 1) * F.lit(blocks)
    bucket = (
        F.when(noised == 1.0, block)
        .when(noised == 0.0, F.lit(4098 * blocks) + block)
        .otherwise(between)
        .cast("long")
    )
    ranked = with_position(measurement, order, bucket, WORKLOAD, "_rank")
    return ranked.where(F.col("_rank") < keep).drop("_rank")


def selected_vectors(measurement: DataFrame, real: DataFrame) -> DataFrame:
    """Noisy and true values of the measured cells. The true values are a non-private diagnostic."""
    return measurement.join(real.select(*KEY, "stat"), KEY).select(*KEY, "noised", F.col("stat").alias("true_stat"))


def without(measurement: DataFrame, workloads: DataFrame) -> DataFrame:
    """Drop the measurements of given workloads; with all of them this is a reset."""
    return measurement.join(workloads.select(*WORKLOAD).distinct(), WORKLOAD, "left_anti")


def fitness(targets: DataFrame, stats: DataFrame) -> DataFrame:
    """One row: squared L2 distance of statistics to the targets; unmeasured cells do not count."""
    gap: C = F.col("noised") - F.coalesce(F.col("stat"), F.lit(0.0))
    joined = targets.join(stats.select(*KEY, "stat"), KEY, "left")
    return joined.agg(F.sum(gap * gap).alias("fitness"))
