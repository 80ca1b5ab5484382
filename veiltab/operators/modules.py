"""Other statistics modules and the chain that puts modules side by side."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.functions.literals import array_lit, array_sql, small_table
from veiltab.functions.bins import add_bins
from veiltab.operators.domain import CONTINUOUS, ORDINAL, Domain, linspace
from veiltab.operators.marginals import StatModule


class _Rates(StatModule):
    """One workload with a single cell per column: how many rows satisfy a condition."""

    def __init__(self, names: list[str]):
        self.names = list(names)

    @property
    def n_workloads(self) -> int:
        return len(self.names)

    def condition(self, name: str):
        raise NotImplementedError

    def targets(self) -> list[tuple[int, list[str], int, list[float]]]:
        return [(i, [n], 1, []) for i, n in enumerate(self.names)]

    def frame(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        keep = range(len(self.names)) if selected is None else selected
        rows = [(i, 0, 1, math.sqrt(2.0), [self.names[i]]) for i in keep]
        return small_table(spark, rows, "workload_id int, level int, n_cells long, sensitivity double, cols array<string>"
        )

    def grid(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        return self.frame(spark, selected).select("workload_id", F.lit(0).cast("long").alias("cell"))

    def counts(self, encoded: DataFrame, selected: list[int] | None = None) -> DataFrame:
        """One aggregate over the table, turned to long form."""
        keep = range(len(self.names)) if selected is None else selected
        cells = [
            F.struct(
                F.lit(i).alias("workload_id"),
                F.lit(0).cast("long").alias("cell"),
                F.count_if(self.condition(self.names[i])).alias("cnt"),
            )
            for i in keep
        ]
        return encoded.agg(F.array(*cells).alias("c")).select(F.inline("c"))


class NullCounts(_Rates):
    name = "null_counts"

    def __init__(self, domain: Domain, names: list[str] | None = None):
        super().__init__(domain.names if names is None else names)

    def condition(self, name: str):
        return F.col(name).isNull()

    def cell_sql(self, x: list[str]) -> str:
        return f"if({x[0]} is null, 0L, null)"

    def cells(self, x: list[np.ndarray], par: list[float]) -> np.ndarray:
        return np.where(np.isnan(x[0]), 0, -1)


class SparseCounts(_Rates):
    """Rate of zeros in the columns the domain marks as sparse."""

    name = "sparse_counts"

    def __init__(self, domain: Domain):
        super().__init__([c.name for c in domain.columns if c.sparse])

    def condition(self, name: str):
        return F.abs(F.col(name).cast("double")) < F.lit(1e-9)

    def cell_sql(self, x: list[str]) -> str:
        return f"if(abs({x[0]}) < 1e-9D, 0L, null)"

    def cells(self, x: list[np.ndarray], par: list[float]) -> np.ndarray:
        return np.where(np.abs(x[0]) < 1e-9, 0, -1)


class Covariance(StatModule):
    """Histogram over [-2, 2) of the product of two standardised columns, for all numeric pairs."""

    name = "covariance"

    def __init__(self, domain: Domain, moments: dict[str, dict[str, float]], n_edges: int = 64):
        self.domain, self.moments, self.n_edges = domain, moments, n_edges
        numeric = domain.of_role(CONTINUOUS) + domain.of_role(ORDINAL)
        self.pairs = list(itertools.combinations(numeric, 2))

    @property
    def n_workloads(self) -> int:
        return len(self.pairs)

    def frame(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        keep = range(len(self.pairs)) if selected is None else selected
        rows = [(i, 0, self.n_edges - 1, math.sqrt(2.0), list(self.pairs[i])) for i in keep]
        return small_table(spark, rows, "workload_id int, level int, n_cells long, sensitivity double, cols array<string>"
        )

    def grid(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        cells = F.sequence(F.lit(0), F.lit(self.n_edges - 2)).cast("array<long>")
        return self.frame(spark, selected).select("workload_id", F.explode(cells).alias("cell"))

    @property
    def edges(self) -> list[float]:
        return list(linspace(-2.0, 2.0, self.n_edges))

    def targets(self) -> list[tuple[int, list[str], int, list[float]]]:
        return [
            (i, list(p), self.n_edges - 1, [self.moments[n][k] for n in p for k in ("mean", "std")])
            for i, p in enumerate(self.pairs)
        ]

    def cell_sql(self, x: list[str]) -> str:
        """The product's interval, by binary search in the edges."""
        a, b = (f"((cast({v} as double) - get(par, {2 * i})) / get(par, {2 * i + 1}))" for i, v in enumerate(x[:2]))
        top = 1 << (self.n_edges.bit_length() - 1)
        steps, edges = array_sql([top >> i for i in range(top.bit_length())]), array_sql(self.edges)
        found = f"aggregate({steps}, 0, (at, s) -> if(at + s <= {self.n_edges} and {a} * {b} >= get({edges}, at + s - 1), at + s, at))"
        return f"cast(nullif(nullif({found}, 0), {self.n_edges}) - 1 as bigint)"

    def cells(self, x: list[np.ndarray], par: list[float]) -> np.ndarray:
        with np.errstate(all="ignore"):  # a column without spread
            product = ((x[0] - par[0]) / par[1]) * ((x[1] - par[2]) / par[3])
        at = np.searchsorted(np.array(self.edges), product, "right")  # NaN comes last
        return np.where((at == 0) | (at == self.n_edges), -1, at - 1)

    def counts(self, encoded: DataFrame, selected: list[int] | None = None) -> DataFrame:
        """Pairs are data: each row's standardised values are held once and met with a table of pairs, so the
        generated code grows with the columns, not with their square."""
        keep = range(len(self.pairs)) if selected is None else selected
        names = sorted({n for p in keep for n in self.pairs[p]})
        place = {n: i for i, n in enumerate(names)}
        z = [(F.col(n).cast("double") - self.moments[n]["mean"]) / F.lit(self.moments[n]["std"]) for n in names]
        pairs = [[p, *(place[n] for n in self.pairs[p])] for p in keep]
        if not pairs:
            return small_table(encoded.sparkSession, [], "workload_id int, cell long, cnt long")
        each = encoded.select(F.array(*z).alias("z"), F.explode(array_lit(pairs)).alias("pair"))
        side = lambda i: F.get("z", F.get("pair", F.lit(i)))
        each = each.select(F.get("pair", F.lit(0)).cast("int").alias("workload_id"), (side(1) * side(2)).alias("product"))
        cells = add_bins(each, {"cell": ("product", self.edges)}, outside=True)
        inside = (F.col("cell") >= 0) & (F.col("cell") < self.n_edges - 1)
        cells = cells.where(inside).select("workload_id", F.col("cell").cast("long").alias("cell"))
        return cells.groupBy("workload_id", "cell").agg(F.count(F.lit(1)).alias("cnt"))


class Chain:
    """Several modules as one table of statistics keyed by (module, workload_id, cell)."""

    def __init__(self, modules: list[StatModule]):
        names = [m.name for m in modules]
        if len(set(names)) != len(names):
            raise ValueError("module names must differ")
        self.modules = {m.name: m for m in modules}

    @property
    def n_workloads(self) -> int:
        return sum(m.n_workloads for m in self.modules.values())

    def others(self, module: StatModule) -> tuple[StatModule, ...]:
        """All modules but the one of this name."""
        return tuple(m for m in self.modules.values() if m.name != module.name)

    def _union(self, parts: list[tuple[str, DataFrame]]) -> DataFrame:
        out = None
        for name, df in parts:
            df = df.select(F.lit(name).alias("module"), "*")
            out = df if out is None else out.unionByName(df)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        cols = ["workload_id", "level", "n_cells", "sensitivity", "cols"]
        return self._union([(n, m.frame(spark).select(*cols)) for n, m in self.modules.items() if m.n_workloads])

    def stats(self, encoded: DataFrame, n_rows: int, modules: list[str] | None = None) -> DataFrame:
        pick = self.modules if modules is None else modules
        return self._union(
            [(n, self.modules[n].stats(encoded, n_rows)) for n in pick if self.modules[n].n_workloads]
        )
