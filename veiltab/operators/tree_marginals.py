"""Marginals on dyadic trees, with the budget split over sets and levels."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.functions.literals import small_table
from veiltab.functions.hashing import gaussian
from veiltab.operators.domain import Domain
from veiltab.operators.histograms import dyadic_edges


@dataclass(frozen=True)
class TreeWorkload:
    cols: tuple[str, ...]
    level: int
    bins: tuple[int, ...]


class TreeMarginals:
    """Each set has as many levels as its deepest column; shallower columns stay at their own finest.

    ``max_cells`` caps how large a workload may be before its finer levels are left out of the plan;
    the sets then have their published size reported in ``info``.
    """

    def __init__(self, domain: Domain, sets: list[tuple[str, ...]], height: int):
        if len({len(s) for s in sets}) != 1:
            raise ValueError("all sets must have the same number of columns")
        self.domain, self.sets, self.height = domain, [tuple(s) for s in sets], height
        self.edges = dyadic_edges(domain, height)

    def height_of(self, cols: tuple[str, ...]) -> int:
        return max(len(self.edges[c]) for c in cols)

    def _bins(self, col: str, level: int) -> int:
        levels = self.edges[col]
        return len(levels[min(level, len(levels) - 1)]) - 1

    @cached_property
    def workloads(self) -> list[TreeWorkload]:
        return [
            TreeWorkload(s, level, tuple(self._bins(c, level) for c in s))
            for s in self.sets
            for level in range(self.height_of(s))
        ]

    def info(self, spark, rho: float, n_rows: int, max_size: int | None = None) -> DataFrame:
        """Levels, cells, budget and noise of every workload; ``max_size`` is split evenly over sets."""
        rows = []
        for w in self.workloads:
            each = rho / len(self.sets) / self.height_of(w.cols)
            sigma = math.sqrt(2.0) / n_rows / math.sqrt(2.0 * each)
            share = None if max_size is None else max_size // len(self.sets)
            rows.append((",".join(w.cols), w.level, math.prod(w.bins), each, sigma, share))
        return small_table(spark, rows, "cols string, level int, n_cells long, rho double, sigma double, max_size long"
        )

    def _finest(self, encoded: DataFrame) -> DataFrame:
        """(set_id, f1..fk, cnt) at the deepest level of every column, one pass for all sets."""
        names = sorted({c for s in self.sets for c in s}, key=self.domain.position)
        bins = {}
        for c in names:
            n, top = self._bins(c, self.height), self.domain[c].range[1]
            b = F.floor(F.col(c) * F.lit(n) / F.lit(top))
            bins[c] = F.greatest(F.lit(0), F.least(F.lit(n - 1), b)).cast("long")
            bins[c] = F.when(F.col(c).isNotNull(), bins[c])
        each = F.array(
            *[
                F.struct(
                    F.lit(i).alias("set_id"), *[bins[c].alias(f"f{j + 1}") for j, c in enumerate(s)]
                )
                for i, s in enumerate(self.sets)
            ]
        )
        k = len(self.sets[0])
        known = reduce(lambda a, b: a & b, [F.col(f"f{j + 1}").isNotNull() for j in range(k)])
        keys = ["set_id", *[f"f{j + 1}" for j in range(k)]]
        return (
            encoded.select(F.explode(each).alias("c")).select("c.*").where(known)
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
        )

    def noisy_stats(self, encoded: DataFrame, n_rows: int, rho: float | None, seed, tag: str) -> DataFrame:
        """(cols, level, b1..bk, stat) of every cell; coarser levels add up the finest counts."""
        spark, k = encoded.sparkSession, len(self.sets[0])
        fields = ", ".join(f"n{j + 1} long, d{j + 1} long, t{j + 1} long" for j in range(k))
        rows = []
        for w in self.workloads:
            each = None if rho is None else rho / len(self.sets) / self.height_of(w.cols)
            sigma = 0.0 if each is None else math.sqrt(2.0) / n_rows / math.sqrt(2.0 * each)
            row = [self.sets.index(w.cols), ",".join(w.cols), w.level, sigma, math.prod(w.bins)]
            for j, c in enumerate(w.cols):
                finest = self._bins(c, self.height)
                row += [w.bins[j], finest // w.bins[j], math.prod(w.bins[j + 1:])]
            rows.append(tuple(row))
        loads = small_table(spark, rows, f"set_id int, cols string, level int, sigma double, n_cells long, {fields}"
        )
        keys = [f"b{j + 1}" for j in range(k)]
        up = [F.floor(F.col(f"f{j + 1}") / F.col(f"d{j + 1}")).cast("long").alias(f"b{j + 1}") for j in range(k)]
        counts = (
            self._finest(encoded).join(F.broadcast(loads), "set_id").select("cols", "level", *up, "cnt")
            .groupBy("cols", "level", *keys).agg(F.sum("cnt").alias("cnt"))
        )
        # Cells are numbered and unfolded into bins; one chunk at a time, so no wide array is built.
        grid = loads.select("*", F.explode(F.expr("sequence(0L, (n_cells - 1) div 8192)")).alias("chunk"))
        grid = grid.select(
            "*", F.explode(F.expr("sequence(chunk * 8192, least((chunk + 1) * 8192, n_cells) - 1)")).alias("cell")
        )
        bins = [
            (F.floor(F.col("cell") / F.col(f"t{j + 1}")) % F.col(f"n{j + 1}")).cast("long").alias(f"b{j + 1}")
            for j in range(k)
        ]
        grid = grid.select("cols", "level", "sigma", "cell", *bins)
        noise = F.col("sigma") * gaussian(seed, tag, F.col("cols"), F.col("level"), F.col("cell"))
        stat = F.coalesce("cnt", F.lit(0)) / F.lit(float(n_rows)) + noise
        return grid.join(counts, ["cols", "level", *keys], "left").select(
            "cols", "level", *keys, stat.alias("stat")
        )
