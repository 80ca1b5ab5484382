"""k-way marginals on several levels of coarseness, from one grouped count.

A row lies in one cell per column set, so a column set costs one exploded record, not one test per
query. Coarse levels are sums of the finest counts and never touch the rows again. Hot cells are
absorbed by the map-side partial count.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.functions.bins import add_bins, bin_table
from veiltab.functions.literals import array_lit, small_table
from veiltab.operators.domain import CATEGORICAL, Column, Domain
from veiltab.session import small_side

KEY_BITS = 62  # of a packed (set or workload, cell)
UNKNOWN_SIZE = 64  # fixed value: edges counted for a column whose edges are not known yet
WIDE_SETS = 64  # up to here one array expression per set, beyond it a table of positions
GRID_CHUNK = 8192


# ---- column sets ---------------------------------------------------------------------------


def set_size(domain: Domain, cols) -> int:
    """Product of sizes; a size-1 column counts its edges, a fixed number if unknown."""
    total = 1
    for n in cols:
        c = domain[n]
        if c.size > 1:
            total *= c.size
        else:
            total *= len(c.edges) if c.edges is not None else UNKNOWN_SIZE
    return total


def column_sets(
    domain: Domain, k: int, max_size: int | None = None, include: str | None = None
) -> list[tuple[str, ...]]:
    """All k-column sets, smaller than ``max_size`` cells and with ``include`` when asked."""
    return [
        s
        for s in itertools.combinations(domain.names, k)
        if (max_size is None or set_size(domain, s) < max_size) and (include is None or include in s)
    ]


def mixed_sets(domain: Domain, k: int) -> list[tuple[str, ...]]:
    """Sets with at least one categorical and one numeric column."""
    roles = lambda s: {domain[n].numeric for n in s}
    return [s for s in itertools.combinations(domain.names, k) if len(roles(s)) == 2]


def conditional_sets(domain: Domain, k: int, conditional=()) -> list[tuple[str, ...]]:
    """Sets without the conditional columns, which are then added to each as extra dimensions."""
    for n in conditional:
        if domain[n].role != CATEGORICAL:
            raise ValueError("conditional columns must be categorical")
    rest = [n for n in domain.names if n not in conditional]
    return [(*s, *conditional) for s in itertools.combinations(rest, min(k, len(rest)))]


# ---- workloads -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Dim:
    """One column of a workload: finest bins, merge stride and bins at this level."""

    pos: int
    n0: int
    stride: int
    n: int
    nullable: bool

    @property
    def width0(self) -> int:
        return self.n0 + self.nullable

    @property
    def width(self) -> int:
        return self.n + self.nullable


@dataclass(frozen=True)
class Workload:
    workload_id: int
    set_id: int
    cols: tuple[str, ...]
    level: int
    dims: tuple[Dim, ...]

    @property
    def n_cells(self) -> int:
        return math.prod(d.width for d in self.dims)


def _strides(widths: list[int]) -> list[int]:
    out, acc = [], 1
    for w in reversed(widths):
        out.append(acc)
        acc *= w
    return out[::-1]


class StatModule:
    """What a statistics module must offer: its workloads and the counts of a table.

    ``frame`` has (workload_id, level, n_cells, sensitivity), ``grid`` every (workload_id, cell),
    ``counts`` the non-empty (workload_id, cell, cnt) of an encoded table. Sensitivity is the L2
    change of the counts when one row is replaced.
    """

    name = "module"

    @property
    def n_workloads(self) -> int:
        raise NotImplementedError

    def frame(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def grid(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        raise NotImplementedError

    def counts(self, encoded: DataFrame, selected: list[int] | None = None) -> DataFrame:
        raise NotImplementedError

    def targets(self) -> list[tuple[int, list[str], int, list[float]]]:
        """(workload, its columns, cells, parameters) of every workload, for a search to match them."""
        raise NotImplementedError(f"{self.name} can be measured, but a search can't match it")

    def cell_sql(self, x: list[str]) -> str:
        """SQL text of a row's cell in a workload of ``targets``, NULL for none.

        ``x`` has texts of the values of its columns, as doubles; the column ``par`` has its parameters.
        A module may also offer ``cells(x, par)``, the same over arrays with NaN for NULL and -1 for none,
        which spares a round its joins.
        """
        raise NotImplementedError(f"{self.name} can be measured, but a search can't match it")

    def stats(
        self, encoded: DataFrame, n_rows: int, selected: list[int] | None = None, dense: bool = True
    ) -> DataFrame:
        """(workload_id, cell, cnt, stat), with empty cells when ``dense``."""
        counts = self.counts(encoded, selected)
        if dense:
            grid = self.grid(encoded.sparkSession, selected)
            counts = grid.join(counts, ["workload_id", "cell"], "left")
        cnt = F.coalesce(F.col("cnt"), F.lit(0)).cast("long")
        return counts.select(
            "workload_id", "cell", cnt.alias("cnt"), (cnt / F.lit(float(max(n_rows, 1)))).alias("stat")
        )


class Marginals(StatModule):
    name = "marginals"

    def __init__(self, domain: Domain, sets: list[tuple[str, ...]], depth: int = 3, room: tuple[int, int] = (0, 1)):
        """``room``: ids and cells per id that packed keys must leave room for beside the workloads."""
        self.domain, self.sets, self.depth, self.room = domain, [tuple(s) for s in sets], depth, room

    @classmethod
    def all_kway(cls, domain: Domain, k: int = 2, depth: int = 3, max_size=None, include=None, conditional=()):
        """All k-way sets; a table with fewer columns than k falls back to all its columns."""
        k = min(k, len(domain.columns))
        sets = (
            conditional_sets(domain, k, conditional)
            if conditional
            else column_sets(domain, k, max_size, include)
        )
        return cls(domain, sets, depth)

    @cached_property
    def workloads(self) -> list[Workload]:
        out = []
        for set_id, s in enumerate(self.sets):
            cols: list[Column] = [self.domain[n] for n in s]
            levels = self.depth if any(c.numeric for c in cols) else 1
            for level in range(levels):
                dims = []
                for c in cols:
                    stride, n = c.coarse(self.depth, level)
                    dims.append(
                        Dim(self.domain.position(c.name), c.finest(self.depth), stride, n, c.has_nulls)
                    )
                out.append(Workload(len(out), set_id, s, level, tuple(dims)))
        return out

    @cached_property
    def shift(self) -> int:
        """A cell is packed as id * 2^shift + cell number, id that of its set or workload."""
        cells = max([self.room[1], *(math.prod(d.width0 for d in w.dims) for w in self.workloads)])
        bits = max(1, (cells - 1).bit_length())
        if bits + (len(self.workloads) + self.room[0]).bit_length() > KEY_BITS:
            raise ValueError(f"a column set has {cells} cells; limit it with max_size")
        return bits

    @property
    def n_workloads(self) -> int:
        return len(self.workloads)

    @property
    def n_cells(self) -> int:
        return sum(w.n_cells for w in self.workloads)

    @property
    def k(self) -> int:
        return max(len(s) for s in self.sets)

    def frame(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        """One row per workload. Missing dimensions of short sets have width 1 and stride 0."""
        fields = ["pos", "n0", "stride", "n", "width0", "at0", "at"]
        schema = "workload_id int, set_id int, level int, n_cells long, sensitivity double, cols array<string>"
        schema += "".join(f", {f}{i} long" for i in range(self.k) for f in fields)
        rows = []
        for w in self.workloads:
            if selected is not None and w.workload_id not in set(selected):
                continue
            at0 = _strides([d.width0 for d in w.dims])
            at = _strides([d.width for d in w.dims])
            row = [w.workload_id, w.set_id, w.level, w.n_cells, math.sqrt(2.0), list(w.cols)]
            for i in range(self.k):
                if i < len(w.dims):
                    d = w.dims[i]
                    row += [d.pos, d.n0, d.stride, d.n, d.width0, at0[i], at[i]]
                else:
                    row += [0, 1, 1, 1, 1, 0, 0]
            rows.append(tuple(row))
        return small_table(spark, rows, schema)

    def level_bin(self, i: int, finest: C) -> C:
        """Bin of dimension i at the workload's level; the null bin stays its own bin."""
        merged = F.least(F.floor(finest / F.col(f"stride{i}")), F.col(f"n{i}") - 1)
        return F.when(finest == F.col(f"n0{i}"), F.col(f"n{i}")).otherwise(merged)

    # ---- counting ----

    def _finest_keys(self, binned: DataFrame, set_ids: list[int]) -> DataFrame:
        """One packed (set, cell) key per row and set."""
        radix = {}
        for w in self.workloads:
            radix.setdefault(w.set_id, _strides([d.width0 for d in w.dims]))
        if len(set_ids) <= WIDE_SETS:
            keys = []
            for s in set_ids:
                cell = reduce(
                    lambda a, b: a + b,
                    [F.col(f"b_{n}").cast("long") * r for n, r in zip(self.sets[s], radix[s])],
                )
                keys.append(F.lit(s << self.shift).cast("long") + cell)
            return binned.select(F.explode(F.array(*keys)).alias("key"))
        # Many sets: the positions are data, so the generated code does not grow with them.
        table = [
            F.struct(
                F.lit(s << self.shift).cast("long").alias("base"),
                F.array(*[F.lit(self.domain.position(n)) for n in self.sets[s]]).alias("pos"),
                F.array(*[F.lit(r).cast("long") for r in radix[s]]).alias("radix"),
            )
            for s in set_ids
        ]
        bins = F.array(*[F.col(f"b_{n}").cast("long") for n in self.domain.names])
        each = binned.select(bins.alias("b"), F.explode(F.array(*table)).alias("t"))
        cell = F.lit(0).cast("long")
        for i in range(self.k):
            part = F.get("b", F.get("t.pos", F.lit(i))) * F.get("t.radix", F.lit(i))
            cell = cell + F.when(F.size("t.pos") > i, part).otherwise(F.lit(0))
        return each.select((F.col("t.base") + cell).alias("key"))

    def finest_counts(self, encoded: DataFrame, set_ids: list[int] | None = None) -> DataFrame:
        """(key, cnt) of non-empty finest cells: the only pass over the rows, one shuffle."""
        set_ids = list(range(len(self.sets))) if set_ids is None else set_ids
        used = sorted({n for s in set_ids for n in self.sets[s]}, key=self.domain.position)
        names = self.domain.names if len(set_ids) > WIDE_SETS else used
        binned = bin_table(encoded.select(*names), self.domain, self.depth, names)
        keys = self._finest_keys(binned, set_ids)
        return keys.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("cnt"))

    def _level_cell(self) -> C:
        """Cell of a workload row (see ``frame``) from the finest cell number in ``finest``."""
        cell = F.lit(0).cast("long")
        for i in range(self.k):
            b0 = F.expr(f"(finest div greatest(at0{i}, 1L)) % width0{i}")
            cell = cell + self.level_bin(i, b0) * F.col(f"at{i}")
        return cell.cast("long")

    def roll_up(
        self, finest: DataFrame, selected: list[int] | None = None, sums: tuple[str, ...] = ("cnt",),
        frame: DataFrame | None = None, n_frame: int | None = None,
    ) -> DataFrame:
        """Sums of every level from sums of the finest cells. ``frame``: other rows than those of ``frame()``."""
        split = finest.select(
            F.shiftright("key", self.shift).cast("int").alias("set_id"),
            F.col("key").bitwiseAND(F.lit((1 << self.shift) - 1)).alias("finest"),
            *sums,
        )
        frame = self.frame(finest.sparkSession, selected) if frame is None else frame
        w = small_side(frame, n_frame or self.n_workloads, 64 + 56 * self.k)
        return (
            split.join(w, "set_id")
            .select("workload_id", self._level_cell().alias("cell"), *sums)
            .groupBy("workload_id", "cell")
            .agg(*[F.sum(c).alias(c) for c in sums])
        )

    def cell_map(self, spark: SparkSession) -> DataFrame:
        """(finest key, level, key): which cell of every level each finest cell belongs to."""
        sizes = {w.set_id: math.prod(d.width0 for d in w.dims) for w in self.workloads}
        sets = small_table(spark, list(sizes.items()), "set_id int, n long")
        chunks = sets.select(
            "set_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {GRID_CHUNK})")).alias("chunk")
        )
        if sum(sizes.values()) > 50 * GRID_CHUNK:
            chunks = chunks.repartition("set_id", "chunk")
        cells = F.expr(f"sequence(chunk * {GRID_CHUNK}, least((chunk + 1) * {GRID_CHUNK}, n) - 1)")
        grid = chunks.select("set_id", F.explode(cells).alias("finest"))
        w = small_side(self.frame(spark), self.n_workloads, 64 + 56 * self.k)
        return grid.join(w, "set_id").select(
            (F.shiftleft(F.col("set_id").cast("long"), self.shift) + F.col("finest")).alias("fkey"),
            "level",
            (F.shiftleft(F.col("workload_id").cast("long"), self.shift) + self._level_cell()).alias("key"),
        )

    @property
    def n_finest(self) -> int:
        return sum({w.set_id: math.prod(d.width0 for d in w.dims) for w in self.workloads}.values())

    def counts(self, encoded: DataFrame, selected: list[int] | None = None) -> DataFrame:
        """A selection of workloads is applied before counting: only their sets are exploded."""
        set_ids = None
        if selected is not None:
            set_ids = sorted({self.workloads[w].set_id for w in selected})
        return self.roll_up(self.finest_counts(encoded, set_ids), selected)

    def grid(self, spark: SparkSession, selected: list[int] | None = None) -> DataFrame:
        """Every cell, empty or not: numbers generated in chunks, spread when there are many."""
        w = self.frame(spark, selected).select("workload_id", "n_cells")
        chunks = w.select(
            "workload_id",
            "n_cells",
            F.explode(F.expr(f"sequence(0L, (n_cells - 1) div {GRID_CHUNK})")).alias("chunk"),
        )
        if self.n_cells > 50 * GRID_CHUNK:
            chunks = chunks.repartition("workload_id", "chunk")
        last = f"least((chunk + 1) * {GRID_CHUNK}, n_cells) - 1"
        return chunks.select(
            "workload_id", F.explode(F.expr(f"sequence(chunk * {GRID_CHUNK}, {last})")).alias("cell")
        )

    def with_bins(self, stats: DataFrame) -> DataFrame:
        """Add level and b1..bk (NULL beyond a set's own columns) to a (workload_id, cell) table."""
        w = self.frame(stats.sparkSession)
        joined = stats.join(small_side(w, self.n_workloads, 64 + 56 * self.k), "workload_id")
        bins = []
        for i in range(self.k):
            b = F.expr(f"cell div greatest(at{i}, 1L)") % self._width(i)
            bins.append(F.when(F.size("cols") > i, b).cast("long").alias(f"b{i + 1}"))
        return joined.select(*stats.columns, "set_id", "level", "cols", *bins)

    @staticmethod
    def _width(i: int) -> C:
        nullable = F.col(f"width0{i}") - F.col(f"n0{i}")
        return F.col(f"n{i}") + nullable

    def boxes(self, spark: SparkSession) -> DataFrame:
        """(workload_id, dim, bin, lo, hi) of every interval, in encoded units; NULL for the null bin."""
        rows = []
        for w in self.workloads:
            for i, (n, d) in enumerate(zip(w.cols, w.dims)):
                c = self.domain[n]
                edges = c.bin_edges(self.depth) if c.numeric else tuple(map(float, range(c.size + 1)))
                lo, hi = c.range
                for b in range(d.n):
                    left = lo if b == 0 else edges[b * d.stride]
                    right = hi if b == d.n - 1 else edges[(b + 1) * d.stride]
                    rows.append((w.workload_id, i + 1, b, float(left), float(right)))
                if d.nullable:
                    rows.append((w.workload_id, i + 1, d.n, None, None))
        return small_table(spark, rows, "workload_id int, dim int, bin long, lo double, hi double")


# ---- histograms and boxes over given edges ---------------------------------------------------


def dense_histogram(df: DataFrame, edges: dict[str, list[float]], n_rows: int) -> DataFrame:
    """k-dimensional histogram over given edges: b1..bk, lo1..hik and the fraction of rows."""
    names = list(edges)
    binned = add_bins(df.select(*names), {f"b_{n}": (n, edges[n]) for n in names})
    keys = [f"b{i + 1}" for i in range(len(names))]
    counts = (
        binned.select(*[F.col(f"b_{n}").cast("long").alias(k) for n, k in zip(names, keys)])
        .dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    )
    widths = [len(edges[n]) - 1 for n in names]
    total, strides = math.prod(widths), _strides(widths)
    grid = df.sparkSession.range(total)
    for k, at, w in zip(keys, strides, widths):
        grid = grid.withColumn(k, (F.floor(F.col("id") / at) % w).cast("long"))
    full = grid.join(counts, keys, "left")
    bounds = []
    for i, n in enumerate(names):
        e, b = array_lit([float(x) for x in edges[n]]), F.col(keys[i]).cast("int")
        bounds += [F.get(e, b).alias(f"lo{i + 1}"), F.get(e, b + 1).alias(f"hi{i + 1}")]
    return full.select(*keys, *bounds, (F.coalesce("cnt", F.lit(0)) / F.lit(float(n_rows))).alias("stat"))


def box_queries(df: DataFrame, boxes: list[tuple[int, dict[str, tuple[float, float]]]], n_rows: int) -> DataFrame:
    """(query_id, stat): fraction of rows in each box of half-open intervals.

    The bounds of all boxes over a column set cut its space into elementary cells. One scan counts the rows
    per set and cell; each box then sums the cells it covers, joined on the first column's bin. Rows are
    never paired with boxes.
    """
    spark = df.sparkSession
    if not boxes:
        return small_table(spark, [], "query_id int, stat double")
    sets = sorted({tuple(sorted(box)) for _, box in boxes})
    inf = float("inf")
    cuts = {(s, c): sorted({float(x) for _, box in boxes if tuple(sorted(box)) == cols for x in box[c]}) for s, cols in enumerate(sets) for c in cols}
    binned = add_bins(df.select(*sorted({c for _, c in cuts})), {f"b{s}_{c}": (c, [-inf, *at, inf]) for (s, c), at in cuts.items()})
    place = {at: {x: i for i, x in enumerate(xs)} for at, xs in cuts.items()}
    asked = []
    for q, box in boxes:
        cols = tuple(sorted(box))
        s = sets.index(cols)
        # bins of [lo, hi): after lo's cut, up to and including hi's
        first = [place[s, c][float(box[c][0])] + 1 for c in cols]
        last = [place[s, c][float(box[c][1])] for c in cols]
        if all(a <= b for a, b in zip(first, last)):
            asked.append((q, s, first, last))
    cells = F.array(*[
        F.struct(F.lit(s).alias("s"), F.array(*[F.col(f"b{s}_{c}").cast("int") for c in cols]).alias("b")) for s, cols in enumerate(sets)
    ])
    counts = (
        binned.select(F.explode(cells).alias("cell")).select("cell.*").where("forall(b, x -> x is not null)")
        .groupBy("s", "b").agg(F.count(F.lit(1)).alias("cnt")).withColumn("at", F.get("b", F.lit(0)))
    )
    want = small_table(spark, asked, "query_id int, s int, first array<int>, last array<int>")
    want = want.withColumn("at", F.explode(F.sequence(F.get("first", F.lit(0)), F.get("last", F.lit(0)))))
    inside = F.expr("forall(transform(b, (x, i) -> x between get(first, i) and get(last, i)), y -> y)")
    found = counts.join(want, ["s", "at"]).where(inside).groupBy("query_id").agg(F.sum("cnt").alias("cnt"))
    out = small_table(spark, [(q,) for q, _ in boxes], "query_id int")
    stat = F.coalesce("cnt", F.lit(0)) / F.lit(float(n_rows))
    return out.join(found, "query_id", "left").select("query_id", stat.alias("stat"))
