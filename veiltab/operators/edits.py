"""Edits of a synthetic table: propose, score and accept, for all rows of a round at once.

State is ``(row_id, v, b)``: encoded values and their finest bins, one array slot per column. Arrays
keep the generated code the same size however wide the table is. A round pairs rows by
``row_id ^ mask``, so a swap or a copy finds its partner with one shuffle; everything up to the choice
of an edit stays in the partition of its pair. Expressions are SQL text, since they are rebuilt every
round and one text is cheaper to send than many calls.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.functions.bins import bin_table
from veiltab.functions.hashing import fast_uniform_sql
from veiltab.functions.literals import array_sql, small_table
from veiltab.functions.ranking import with_running_sum
from veiltab import session
from veiltab.operators.arrays import Scores, Values, potentials_of
from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL, Domain, linspace
from veiltab.operators.marginals import Marginals, StatModule
from veiltab.operators.sampling import spread, start_of
from veiltab.session import lookup, small_side

MUTATE, FILL, QUANTILE, SWAP, COPY1, COPY2 = "mutate", "fill", "continuous", "swap", "cross1", "cross2"
GRID_VALUES = 4096  # runs of bins of a wide column that quantiles tell apart
SLOTS_PER_CELL = 2  # of the table that guided draws look up
SHARE_BITS = 40  # of the whole-number weight of a share of the rows
CELLS_PER_BUCKET = 50_000
GOLDEN = 0.6180339887498949
QUANTILE_POINTS = 32
ROWS_PER_TASK = 100_000
SLOTS = 1000
# The order of the draws of one candidate.
DRAWS = ["op", "mutate.col", "quantile.col", "swap.col", "copy.col1", "copy.col2", "value.bin", "value.in", "fill.cell", "fill.in"]
EDIT = ["pair_id", "side", "cand", "op", "c1", "c2", "x1", "x2", "y1", "y2"]


def expand_operators(names: tuple[str, ...], domain: Domain) -> list[str]:
    """Edit operators that the domain's columns allow; ``cross`` stands for its two variants."""
    n_cat, n_num = len(domain.of_role(CATEGORICAL)), len(domain.of_role(ORDINAL, CONTINUOUS))
    out = []
    for n in names:
        if n == MUTATE:
            out += [MUTATE, FILL]
        elif n in (FILL, SWAP):
            out.append(n)
        elif n == QUANTILE and n_num:
            out.append(n)
        elif n == "cross":
            out += [COPY1] * (n_cat > 0) + [COPY2] * (n_cat > 1)
    return out


def mixed_weights(weights: list[float]) -> list[float]:
    """The mix operators are drawn from: 0.95 w + 0.05 / n."""
    return [0.95 * w + 0.05 / len(weights) for w in weights]


def update_weights(weights: list[float], rewards: list[float], rate: float = 0.1) -> list[float]:
    """Multiplicative update w * exp(rate * r / p), renormalised."""
    mix = mixed_weights(weights)
    raw = [w * math.exp(rate * r / p) for w, r, p in zip(weights, rewards, mix)]
    return [w / sum(raw) for w in raw]


def to_state(table: DataFrame, domain: Domain, depth: int) -> DataFrame:
    binned = bin_table(table, domain, depth)
    return binned.select(
        "row_id",
        F.array(*[F.col(n).cast("double") for n in domain.names]).alias("v"),
        F.array(*[F.col(f"b_{n}").cast("int") for n in domain.names]).alias("b"),
    )


def values_inside(edits: Edits, tag: str, keep: str = "false") -> str:
    """SQL text of values drawn inside the bins b of a row, or its own v where ``keep`` holds."""
    drawn = fast_uniform_sql(f"{edits.seed}|{edits.run}|{tag}", "spread", "row_id", "c")
    inside = edits._inside("c", "get(b, c)", drawn)
    own = inside if keep == "false" else f"if({keep}, get(v, c), {inside})"
    return f"transform(sequence(0, {len(edits.domain.columns) - 1}), c -> {own}) as v"


def spread_state(state: DataFrame, rows: int, n: int, edits: Edits, tag: str) -> DataFrame:
    """A state of n rows from one of ``rows`` with ids 0..rows-1: every row stands for as many copies.

    Copies keep the bins, so shares stay as they were (to less than 1 / n a row); but for the first they get
    values of their own inside those bins.
    """
    copies = spread(state.withColumnRenamed("row_id", "_at"), rows, n, start_of(f"{edits.seed}|{tag}", rows))
    return copies.selectExpr("row_id", values_inside(edits, tag, "_copy = 0"), "b")


def from_state(state: DataFrame, domain: Domain) -> DataFrame:
    kind = {CATEGORICAL: "int", ORDINAL: "long"}
    cols = [
        F.get("v", F.lit(i)).cast(kind.get(c.role, "double")).alias(c.name)
        for i, c in enumerate(domain.columns)
    ]
    return state.select("row_id", *cols)


class Targets:
    """Statistics that a search matches: marginals, and the workloads of other modules numbered after theirs.

    A key packs the workload and its cell. Other modules have one level, so the finest cell is the cell.
    """

    def __init__(self, marginals: Marginals, others: tuple[StatModule, ...] = ()):
        self.others = [m for m in others if m.n_workloads]
        self.first, self.rows, ids = {marginals.name: 0}, [], marginals.n_workloads
        for kind, module in enumerate(self.others, 1):
            self.first[module.name] = ids
            self.rows += [(kind, ids + w, names, n, [float(p) for p in par]) for w, names, n, par in module.targets()]
            ids += module.n_workloads
        if self.others:
            room = (ids - marginals.n_workloads, max(r[3] for r in self.rows))
            marginals = Marginals(marginals.domain, marginals.sets, marginals.depth, room)
        self.marginals, self.n_workloads = marginals, ids
        self.n_keys = marginals.n_finest + sum(r[3] for r in self.rows)
        self.width = max([marginals.k, *(len(r[2]) for r in self.rows)])
        self.widest = max([w.n_cells for w in marginals.workloads] + [r[3] for r in self.rows])

    @property
    def modules(self) -> list[StatModule]:
        return [self.marginals, *self.others]

    def key(self, module: StatModule) -> C:
        """Key of the columns workload_id and cell of a module."""
        ids = (F.col("workload_id") + F.lit(self.first[module.name])).cast("long")
        return F.shiftleft(ids, self.marginals.shift) + F.col("cell")

    def frame(self, spark: SparkSession) -> DataFrame:
        """The marginals' workloads; others as sets of one dimension that is the cell itself."""
        frame = self.marginals.frame(spark)
        if not self.others:
            return frame
        short = [0, 1, 1, 1, 1, 0, 0] * (self.marginals.k - 1)
        rows = [(i, i, 0, n, 1.0, [], 0, n, 1, n, n, 1, 1, *short) for _, i, _, n, _ in self.rows]
        return frame.union(small_table(spark, rows, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)))

    def cell_map(self, spark: SparkSession) -> DataFrame:
        cells = self.marginals.cell_map(spark)
        for m in self.others:
            own = m.grid(spark).select(self.key(m).alias("key"))
            cells = cells.unionByName(own.select(F.col("key").alias("fkey"), F.lit(0).alias("level"), "key"))
        return cells


@dataclass
class Slots:
    """Cells that lack rows as a table (slot, f1, i1, f2, i2): two columns and their bins, -1 for no second one.

    A cell holds as many of the ``count`` slots as its share of what is lacking says, give or take one.
    """

    table: DataFrame
    count: int


def slots_of(cells: DataFrame, order: list[str], bucket: C, count: int, offset: float, total: int | None = None) -> Slots:
    """Slots of cells (f1, i1, f2, i2, w and the columns of ``order``) in proportion to the whole numbers w.

    Running sums over w cut [0, total) among the cells; slot k belongs to the cell that holds the point
    (k + offset) * total / count. ``bucket`` does not decrease along ``order``.
    """
    total = total or cells.agg(F.sum("w")).first()[0]
    if not total:
        return Slots(cells.select(F.lit(0).cast("long").alias("slot"), "f1", "i1", "f2", "i2").limit(0), 0)
    shift = int(offset * total)
    summed = with_running_sum(cells, "w", order, bucket)
    # the first slot whose point is not below x, in whole numbers
    low, high = (f"greatest(0L, (cast({x} as decimal(38,0)) * {count} - {shift} + {total - 1}) div {total})" for x in ("upto - w", "upto"))
    each = summed.selectExpr("f1", "i1", "f2", "i2", f"{low} as low", f"least({high}, {count}L) as high").where("low < high")
    return Slots(each.selectExpr("explode(sequence(low, high - 1)) as slot", "f1", "i1", "f2", "i2"), count)


class Edits:
    """Proposals and scores for one measurement target over a set of marginals and other modules."""

    def __init__(
        self, marginals: Marginals | Targets, n_rows: int, operators: list[str], seed, run: str = "run",
        candidates: int = 1, draw=fast_uniform_sql,
    ):
        self.targets = marginals if isinstance(marginals, Targets) else Targets(marginals)
        marginals = self.targets.marginals
        self.marginals, self.domain, self.n_rows = marginals, marginals.domain, n_rows
        self.operators, self.seed, self.run = operators, seed, run
        self.candidates, self.draw = candidates, draw
        self.code = {o: operators.index(o) if o in operators else -1 for o in (MUTATE, FILL, QUANTILE, SWAP, COPY1, COPY2)}
        self._touch: DataFrame | None = None
        self._touch_rows = 0
        self.max_level = max(1, math.ceil(math.log2(max(n_rows, 2))) + 2)

    # ---- proposals ----

    def _u(self, tag: str, round_no: int, *keys: str) -> str:
        # Seed, run and round travel as one string: a string is not part of the generated code, so
        # every round reuses the compiled code of the first.
        return self.draw(f"{self.seed}|{self.run}|{round_no}", tag, *keys)

    def stream(self, round_no: int) -> str:
        """SQL text of the hash that the draws of a round go on from."""
        return f"xxhash64('{self.seed}|{self.run}|{round_no}')"

    def _draws(self, round_no: int):
        """Draws per (row or pair, candidate): exact ones for checks, else mixed from one hash each."""
        if self.draw is not fast_uniform_sql:
            return [], lambda tag, key: self._u(tag, round_no, key, "cand")
        stream = f"'{self.seed}|{self.run}|{round_no}'"
        base = [f"xxhash64({stream}, {k}, cand) as h_{k}" for k in ("row_id", "pair_id")]
        scale = f"{float(1 << 52)!r}D"
        return base, lambda tag, key: (
            f"((shiftrightunsigned(xxhash64(h_{key}, {DRAWS.index(tag)}), 12) + 0.5D) / {scale})"
        )

    def quantiles(self, state: DataFrame) -> list[list[float]]:
        """Per column 0, 32 quantiles of the current table and the size.

        They are read off the counts of the finest bins, evenly filled: whole numbers, so the same with
        any partitioning. Columns with more than GRID_VALUES bins are counted in that many equal runs of bins.
        """
        return self.quantiles_of(self.bin_counts(state))

    def bin_counts(self, state: DataFrame) -> dict[int, dict[int, int]]:
        """Rows per numeric column and run of finest bins."""
        cols, depth = self.domain.columns, self.marginals.depth
        steps = [max(1, -(-c.finest(depth) // GRID_VALUES)) if c.numeric else 0 for c in cols]
        rows = (
            state.selectExpr("posexplode(b) as (i, bin)")
            .selectExpr("i", f"get({array_sql([c.finest(depth) for c in cols])}, i) as n", f"get({array_sql(steps)}, i) as step", "bin")
            .where("step > 0 and bin < n").selectExpr("i", "bin div step as bin")
            .groupBy("i", "bin").agg(F.count(F.lit(1)).alias("n"))
        )
        found: dict[int, dict[int, int]] = {}
        for r in rows.collect():  # a row per column and bin
            found.setdefault(r["i"], {})[r["bin"]] = r["n"]
        return found

    def quantiles_of(self, counts: dict[int, dict[int, int]]) -> list[list[float]]:
        cols, depth = self.domain.columns, self.marginals.depth
        step = [max(1, -(-c.finest(depth) // GRID_VALUES)) for c in cols]
        return self.grid({i: self._quantiles_of(cols[i], own, step[i]) for i, own in counts.items()})

    def _quantiles_of(self, c, counts: dict[int, int], step: int) -> list[float]:
        if self._direct(c):
            left = lambda b: float(b * step)
        else:
            edges = c.bin_edges(self.marginals.depth)
            left = lambda b: edges[min(b * step, len(edges) - 1)]
        total, before, out = sum(counts.values()), 0, []
        points = [total * k / (QUANTILE_POINTS - 1) for k in range(QUANTILE_POINTS)]
        for b, n in sorted(counts.items()):
            while len(out) < QUANTILE_POINTS and points[len(out)] <= before + n:
                part = (points[len(out)] - before) / n
                out.append(left(b) if self._direct(c) else left(b) + part * (left(b + 1) - left(b)))
            before += n
        return out + out[-1:] * (QUANTILE_POINTS - len(out))

    def grid(self, found: dict[int, list[float]]) -> list[list[float]]:
        """Quantile lists of all columns, 0 where nothing was found."""
        return [[0.0, *(found.get(i) or [0.0] * QUANTILE_POINTS), float(c.size)] for i, c in enumerate(self.domain.columns)]

    def lacking_cells(self, residuals: DataFrame) -> DataFrame:
        """(key, f1, i1, f2, i2, lack): all finest cells that lack rows, by their share; f2 is -1 for no second column.

        Cells of larger sets are offered by each pair of their columns.
        """
        m, rows = self.marginals, []
        for w in (w for w in m.workloads if w.level == 0):
            strides = [math.prod(d.width for d in w.dims[i + 1:]) for i in range(len(w.dims))]
            dims = [(d.pos, stride, d.width) for d, stride in zip(w.dims, strides)]
            pairs = list(itertools.combinations(dims, 2)) or [(dims[0], (-1, 1, 1))]
            rows += [(w.workload_id, *one, *two, len(pairs)) for one, two in pairs]
        offered = small_table(residuals.sparkSession, rows, "workload_id int, f1 int, s1 long, n1 long, f2 int, s2 long, n2 long, parts int")
        short = residuals.where("r > 0").selectExpr(
            "key", "r", f"cast(shiftright(key, {m.shift}) as int) as workload_id", f"key & {(1 << m.shift) - 1}L as cell"
        )
        return short.join(small_side(offered, len(rows), 128), "workload_id").selectExpr(
            "key", "f1", "cast(cell div s1 % n1 as int) as i1", "f2", "if(f2 < 0, -1, cast(cell div s2 % n2 as int)) as i2", "r / parts as lack"
        )

    def lacking(self, residuals: DataFrame, round_no: int = 0) -> Slots:
        """Slots of all cells that lack rows, in proportion to what they lack."""
        cells = self.lacking_cells(residuals).selectExpr("*", f"greatest(1L, cast(lack * {float(1 << SHARE_BITS)!r}D as bigint)) as w")
        of = cells.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("total"), F.max("key").alias("top")).first()
        buckets = max(1, of["n"] // CELLS_PER_BUCKET)
        bucket = F.expr(f"cast(key / {(of['top'] or 0) + 1}D * {buckets} as int)")
        return slots_of(cells, ["key", "f1", "f2"], bucket, SLOTS_PER_CELL * of["n"], (round_no * GOLDEN) % 1.0, of["total"])

    def partitions(self, spark: SparkSession) -> int:
        """Tasks of a round. Scoring multiplies the rows, so bytes on the way in say too little."""
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n_rows // ROWS_PER_TASK))

    def mask(self, round_no: int) -> int:
        bits = max(1, math.ceil(math.log2(max(self.n_rows, 2))))
        return 1 + (round_no * 0x9E3779B1) % ((1 << bits) - 1) if bits > 1 else 1

    def pairs(self, state: DataFrame, round_no: int) -> DataFrame:
        """(pair_id, m): the rows of each pair of this round; one shuffle, at most two rows each."""
        return (
            state.selectExpr("*", f"least(row_id, row_id ^ {self.mask(round_no)}L) as pair_id")
            .repartition(self.partitions(state.sparkSession), "pair_id")
            .groupBy("pair_id")
            .agg(F.expr("sort_array(collect_list(struct(row_id, v, b))) as m"))
        )

    def operator_slots(self, weights: list[float]) -> list[int]:
        """Operator numbers in proportion to their weights; drawing one is an array access."""
        slots, acc = [], 0.0
        for i, w in enumerate(mixed_weights(weights)):
            acc += w
            slots += [i] * (round(acc * SLOTS) - len(slots))
        return slots

    def propose(
        self, pairs: DataFrame, round_no: int, weights: list[float], quantiles: list[list[float]],
        lacking: Slots | None = None,
    ) -> DataFrame:
        """Adds op, edited columns c1/c2, their new values x1/x2 and bins y1/y2.

        Each row gets ``candidates`` proposals. The operator is drawn per pair, as both rows of a
        swap must agree; a row without a partner has nothing to swap or copy. A guided edit puts the
        row into a cell of the ``lacking`` slots. Rows are dealt out over the slots by the golden ratio
        times their number, which pairs any run of rows evenly with the slots, so no cell is crowded.
        """
        df = self.drawn(pairs, round_no, weights, lacking)
        keep = ["pair_id", "side", "row_id", "v", "b", "pv", "pb", "cand", "op", "c1", "c2"]
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join([*(f"{n} {kinds[n]}" for n in keep), "x1 double, x2 double, y1 int, y2 int"])
        return df.mapInArrow(Values(self, quantiles).run(keep), schema)

    def drawn(self, pairs: DataFrame, round_no: int, weights: list[float], lacking: Slots | None = None) -> DataFrame:
        """Candidates of each row with op, c1, c2, and what their values are made of: the cell's bins i1, i2, and draws.

        pv and pb are the partner's values and bins, a row's own if it has no partner.
        """
        d, (base, u) = self.domain, self._draws(round_no)
        by_weight = [i for i, c in enumerate(d.columns) for _ in range(c.weight)]
        numeric = [d.position(n) for n in d.of_role(CONTINUOUS) + d.of_role(ORDINAL)] or [0]
        cats = [d.position(n) for n in d.of_role(CATEGORICAL)] or [0]

        def pick(ids: list, tag: str, key: str) -> str:
            return f"get({array_sql(ids)}, cast(floor({u(tag, key)} * {len(ids)}) as int))"

        slots, code = self.operator_slots(weights), self.code
        pairwise = f"({code[SWAP]}, {code[COPY1]}, {code[COPY2]})"
        borrowed = f"op in {pairwise}"
        fill = code[FILL] >= 0 and lacking is not None and lacking.count > 0
        cell = ["f1", "i1", "nullif(f2, -1)", "nullif(i2, -1)"]
        second = f"when op = {code[FILL]} then {cell[2]} " if fill else ""
        df = (
            pairs.selectExpr("pair_id", "m", "posexplode(m) as (side, me)")
            .selectExpr(
                "pair_id", "side", "me.row_id", "me.v", "me.b",
                "if(size(m) = 2, get(m, 1 - side).v, null) as pv",
                "if(size(m) = 2, get(m, 1 - side).b, null) as pb",
            )
            .selectExpr("*", f"explode(sequence(0, {self.candidates - 1})) as cand")
            .selectExpr("*", *base)
            .selectExpr("*", f"{pick(slots, 'op', 'pair_id')} as op0")
            .selectExpr("* except (op0)", f"if(op0 in {pairwise} and pv is null, null, op0) as op")
        )
        if fill:
            df = df.selectExpr("*", f"{self._even(u, round_no)} as uf", f"{u('fill.in', 'row_id')} as ub2")
            df = df.selectExpr("* except (uf)", f"if(op = {code[FILL]}, cast(floor(uf * {lacking.count}) as bigint), null) as slot")
            df = lookup(df, lacking.table, ["slot"], lacking.count)
        df = (
            df.selectExpr(
                "*",
                f"case op when {code[MUTATE]} then {pick(by_weight, 'mutate.col', 'row_id')} "
                + (f"when {code[FILL]} then {cell[0]} " if fill else "")
                + f"when {code[QUANTILE]} then {pick(numeric, 'quantile.col', 'row_id')} "
                f"when {code[SWAP]} then {pick(list(range(len(d.columns))), 'swap.col', 'pair_id')} "
                f"else if(op is null or op = {code[FILL]}, null, {pick(cats, 'copy.col1', 'row_id')}) end as c1",
                f"case when op = {code[COPY2]} then {pick(cats, 'copy.col2', 'row_id')} {second}end as c2_",
                f"{u('value.bin', 'row_id')} as ua",
                f"{u('value.in', 'row_id')} as ub",
            )
            .selectExpr("* except (c2_)", "if(c2_ <> c1, c2_, null) as c2")
        )
        made = [f"{cell[1]} as i1", f"{cell[3]} as i2", "ub2"] if fill else ["cast(null as int) as i1", "cast(null as int) as i2", "0D as ub2"]
        return df.selectExpr(
            "pair_id", "side", "row_id", "v", "b", "coalesce(pv, v) as pv", "coalesce(pb, b) as pb", "cand", "op", "c1", "c2", "ua", "ub", *made
        )

    def _even(self, u: Callable[[str, str], str], round_no: int) -> str:
        """Where a row meets the slots, in [0, 1): an exact draw for checks, else evenly spread over the rows."""
        if self.draw is not fast_uniform_sql:
            return u("fill.cell", "row_id")
        return f"pmod((row_id * {self.candidates}L + cand) * {GOLDEN!r}D + {(round_no * 0.7548776662466927) % 1.0!r}D, 1D)"

    @property
    def _all_levels(self) -> int:
        return (1 << self.marginals.depth) - 1

    def _merged_bin(self, col: str, b: str) -> str:
        """Bin of finest bin ``b`` of column number ``col`` at level ``v``; a null bin stays its own."""
        cols, depth = self.domain.columns, self.marginals.depth
        n0 = f"get({array_sql([c.finest(depth) for c in cols])}, {col})"
        coarse = [[c.coarse(depth, v) for v in range(depth)] for c in cols]
        stride = f"get(get({array_sql([[x for x, _ in c] for c in coarse])}, {col}), v)"
        n = f"get(get({array_sql([[x for _, x in c] for c in coarse])}, {col}), v)"
        return f"if({b} = {n0}, {n}, least(cast({b} / {stride} as int), {n} - 1))"

    def _levels_where(self, condition: str) -> str:
        """Bit mask of the levels ``v`` on which a condition holds."""
        return f"aggregate(sequence(0, {self.marginals.depth - 1}), 0, (m, v) -> if({condition}, m | shiftleft(1, v), m))"

    def _level_mask(self, col: str, y: str) -> str:
        """Levels on which column ``col`` changes its bin when it goes to finest bin ``y``."""
        old = f"get(b, {col})"
        moves = f"{self._merged_bin(col, old)} <> {self._merged_bin(col, y)}"
        return f"if({col} is null, null, {self._levels_where(moves)})"

    def _agreement(self) -> str:
        """Per column the levels on which a row and its partner share a bin."""
        same = f"{self._merged_bin('i', 'get(b, i)')} = {self._merged_bin('i', 'get(pb, i)')}"
        each = f"transform(sequence(0, {len(self.domain.columns) - 1}), i -> {self._levels_where(same)})"
        return f"if(pb is null, null, {each})"

    def _inside(self, col: str, i: str, u: str) -> str:
        """A value of column ``col`` in its finest bin ``i``. Where bins are values, the bin number itself."""
        cols, edges = self.domain.columns, []
        for c in cols:
            if c.role == CONTINUOUS:
                edges.append([float(e) for e in c.bin_edges(self.marginals.depth)])
            elif c.role == ORDINAL and c.edges is not None:
                edges.append([float(math.ceil(e)) for e in c.edges])
            else:
                edges.append([])
        e = f"get({array_sql(edges)}, {col})"
        whole = f"get({array_sql([c.role != CONTINUOUS for c in cols])}, {col})"
        top = f"get({array_sql([float(c.size - 1) for c in cols])}, {col})"
        left, right = f"get({e}, {i})", f"get({e}, {i} + 1)"
        stepped = f"least({left} + floor({u} * greatest({right} - {left}, 1.0D)), {top})"
        within = f"{left} + {u} * ({right} - {left})"
        if any(c.sparse and c.role == CONTINUOUS for c in cols):  # zeros would never be drawn from an interval
            zeros = f"get({array_sql([c.sparse for c in cols])}, {col}) and {left} <= 0.0D and {right} > 0.0D"
            half = f"if({u} < 0.5D, 0.0D, {left} + (2.0D * {u} - 1.0D) * ({right} - {left}))"
            within = f"if({zeros}, {half}, {within})"
        inside = f"if({whole}, {stepped}, {within})"
        real = f"{i} < get({array_sql([c.finest(self.marginals.depth) for c in cols])}, {col})"
        return f"if({real}, if({left} is null, cast({i} as double), {inside}), null)"

    @staticmethod
    def _direct(c) -> bool:
        """The bin is the value itself."""
        return c.role == CATEGORICAL or (c.role == ORDINAL and c.edges is None)

    # ---- scoring ----

    def touch(self, spark: SparkSession) -> DataFrame:
        """(edit, set...): the column sets that contain each column, of other modules too. Built once per run."""
        if self._touch is not None:
            return self._touch
        m, rows = self.marginals, []
        by_set: dict[int, list] = {}
        for w in m.workloads:
            by_set.setdefault(w.set_id, []).append(w)
        for set_id, levels in by_set.items():
            first = levels[0]
            strides = [math.prod(d.width0 for d in first.dims[i + 1:]) for i in range(len(first.dims))]
            dims = []
            for i in range(self.targets.width):  # a missing dimension repeats the first with stride 0
                dims += [first.dims[i].pos, strides[i]] if i < len(first.dims) else [first.dims[0].pos, 0]
            members = [d.pos for d in first.dims]
            rows += [(pos, set_id, members, *dims, 0, []) for pos in members]
        for kind, ids, names, _, par in self.targets.rows:
            members = [self.domain.position(n) for n in names]
            dims = [x for i in range(self.targets.width) for x in (members[min(i, len(members) - 1)], 0)]
            rows += [(pos, ids, members, *dims, kind, par) for pos in members]
        fields = "".join(f", pos{i} int, at0{i} long" for i in range(self.targets.width))
        self._touch_rows = len(rows)
        self._touch = small_table(spark, rows, f"edit int, set_id int, members array<int>{fields}, kind int, par array<double>")
        return self._touch

    def _finest_key(self, bins: str, values: str) -> str:
        """Packed (set, finest cell) of a row's bins, or of its values for another module than the marginals."""
        base = f"shiftleft(cast(set_id as bigint), {self.marginals.shift})"
        parts = [f"get({bins}, pos{i}) * at0{i}" for i in range(self.marginals.k)]
        own = f"{base} + {' + '.join(parts)}"
        if not self.targets.others:
            return own
        x = [f"get({values}, pos{i})" for i in range(self.targets.width)]
        others = " ".join(f"when {kind} then {m.cell_sql(x)}" for kind, m in enumerate(self.targets.others, 1))
        return f"if(kind = 0, {own}, {base} + case kind {others} end)"

    def touched(self, edits: DataFrame, carry: list[str], keep_all: bool) -> DataFrame:
        """(carry, old, new, moved): the finest cell a row leaves and enters in each touched set.

        ``keep_all`` also keeps rows without any move, with NULL cells.
        """
        def after(new: str, old: str) -> str:
            slots = (f"case when c1 = {i} then {new}1 when c2 = {i} then {new}2 else get({old}, {i}) end" for i in range(len(self.domain.columns)))
            return f"array({', '.join(slots)}) as n{old}"

        others = bool(self.targets.others)
        explode = "explode_outer" if keep_all else "explode"
        each = edits.selectExpr(
            "*", after("y", "b"), *([after("x", "v")] if others else []), f"{explode}(array_compact(array(c1, c2))) as edit"
        )
        touch = self.touch(edits.sparkSession)
        touch = small_side(touch, self._touch_rows, 128 + 20 * self.targets.width)
        joined = each.join(touch, "edit", "left" if keep_all else "inner")
        # A set holding both edited columns is seen from the first one only.
        real = "(edit = c1 or not array_contains(members, c1))"
        cells = [f"{self._finest_key('b', 'v')} as old", f"{self._finest_key('nb', 'nv')} as new"]
        if not keep_all:
            return joined.where(real).selectExpr(*carry, *cells).where("not (old <=> new)")
        # One edited column moves the row on its own levels; two do on the levels of either. Where
        # the rows of a swap agree in all other columns of the set, nothing moves.
        both = "if(edit = c1, m1 | if(c2 is not null and array_contains(members, c2), m2, 0), m2)"
        agree = " & ".join(
            f"if(pos{i} = c1, {self._all_levels}, get(eq, pos{i}))" for i in range(self.marginals.k)
        )
        moved = f"if(op = {self.code[SWAP]}, {both} & ~({agree}), {both})"
        if others:
            # A swap doesn't change how many rows have a value.
            joined = joined.selectExpr("*", *cells)
            stays = f"old <=> new or (op = {self.code[SWAP]} and size(members) = 1)"
            moved, cells = f"if(kind = 0, {moved}, if({stays}, 0, 1))", ["old", "new"]
        return joined.selectExpr(*carry, f"if({real}, {moved}, 0) as moved", *cells).selectExpr(
            *carry, "moved", "if(moved > 0, old, null) as old", "if(moved > 0, new, null) as new"
        )

    def potentials(self, cell_map: DataFrame, residuals: DataFrame) -> DataFrame:
        """(key, p, levels) of every finest cell: sum of 2 r / N' over its levels that have a target.

        With it a row needs one look-up per column set instead of one per set and level.
        """
        n = f"{float(self.n_rows)!r}D"
        return (
            cell_map.join(residuals, "key").groupBy(F.col("fkey").alias("key"))
            .agg(F.expr(f"sum(2.0D * r / {n}) as p"), F.expr("bit_or(shiftleft(1, level)) as levels"))
        )

    def score(self, proposals: DataFrame, potentials: DataFrame) -> DataFrame:
        """Exact change of the squared distance if a unit alone is applied.

        With r = target - count/N', moving one row from cell a to cell b changes the distance by
        (2 r_a + 1/N') / N' - (2 r_b - 1/N') / N'. Cells without a target add nothing, and levels on
        which the row stays in its cell cancel. A swap is one unit of two rows; the two rows share no
        cell they move in, so their changes add up. Cells of products may be shared by the two rows: there
        the sum is off by a few 1/N'^2, which matters for the order of edits only, as sets of edits are
        accepted by their exact change.
        """
        n = float(self.n_rows)
        masks = [f"{self._agreement()} as eq", f"{self._level_mask('c1', 'y1')} as m1", f"{self._level_mask('c2', 'y2')} as m2"]
        moves = self.touched(proposals.selectExpr("*", *masks), EDIT, keep_all=True)
        p_old = potentials.selectExpr("key as old", "p as p_old", "levels as l_old")
        p_new = potentials.selectExpr("key as new", "p as p_new", "levels as l_new")
        moves = lookup(lookup(moves, p_old, ["old"], self.targets.n_keys), p_new, ["new"], self.targets.n_keys)
        own = (
            "coalesce(p_old, 0D) - coalesce(p_new, 0D) + "
            f"(coalesce(bit_count(l_old & moved), 0) + coalesce(bit_count(l_new & moved), 0)) * {1.0 / n / n!r}D"
        )
        scored = moves.groupBy(*EDIT).agg(F.expr(f"sum({own}) as own"))
        unit = f"if(op = {self.code[SWAP]}, sum(own) over (partition by pair_id, cand), own) as change"
        return scored.selectExpr("* except (own)", unit)

    def choose(self, scored: DataFrame) -> DataFrame:
        """One edit per row: the pair's best swap, or the best edit of each row on its own."""
        if self.candidates == 1:
            return scored
        swap = f"op = {self.code[SWAP]}"
        over = "over (partition by pair_id)"
        best = [
            f"min(if(not ({swap}) and side = {s}, struct(change, cand), null)) {over} as best{s}" for s in (0, 1)
        ]
        best.append(f"min(if({swap}, struct(change, cand), null)) {over} as swap")
        alone = "least(coalesce(best0.change, 0D), 0D) + least(coalesce(best1.change, 0D), 0D)"
        mine = "coalesce(if(side = 0, best0.cand, best1.cand), swap.cand, 0)"
        return (
            scored.selectExpr("*", *best)
            .selectExpr("*", f"coalesce(swap.change < {alone}, false) as together")
            .where(f"cand = if(together, swap.cand, {mine})")
            # A row left with a swap its partner did not choose keeps its values.
            .selectExpr("* except (change)", f"if({swap} and not together, 0D, change) as change")
            .drop("best0", "best1", "swap", "together")
        )

    def with_rows(self, chosen: DataFrame, pairs: DataFrame) -> DataFrame:
        """Put the rows back: both sides are already partitioned by pair, so nothing is moved."""
        return chosen.join(pairs.hint("merge"), "pair_id").selectExpr(
            "pair_id", "get(m, side).row_id as row_id", "get(m, side).v as v", "get(m, side).b as b",
            *EDIT[2:], "change",
        )

    def best(
        self, pairs: DataFrame, round_no: int, weights: list[float], quantiles: list[list[float]], lacking: Slots | None,
        potentials: DataFrame,
    ) -> DataFrame:
        """The chosen edit of every row, with the row: ``propose``, ``score``, ``choose`` and ``with_rows`` in one pass.

        Potentials are held by each task. Where they or the slots are too many to be broadcast, or a module
        has no ``cells``, edits meet them by joins.
        """
        most = max(self.targets.n_keys, lacking.count if lacking is not None else 0)
        if most * 64 > session.BROADCAST_BYTES or not all(hasattr(m, "cells") for m in self.targets.others):
            proposals = self.propose(pairs, round_no, weights, quantiles, lacking)
            return self.with_rows(self.choose(self.score(proposals, potentials)), pairs)
        keep = ["pair_id", "row_id", "v", "b", "cand", "op", "c1", "c2"]
        df = self.drawn(pairs, round_no, weights, lacking)
        kinds = {f.name: f.dataType.simpleString() for f in df.schema}
        schema = ", ".join([*(f"{n} {kinds[n]}" for n in keep), "x1 double, x2 double, y1 int, y2 int, change double"])
        scores = Scores(self, *potentials_of(self, potentials.toArrow()))  # at most BROADCAST_BYTES / 64 cells
        return df.mapInArrow(scores.run(Values(self, quantiles), keep), schema)

    def with_levels(self, scored: DataFrame, round_no: int, best: float | None) -> DataFrame:
        """Levels that make nested random sets of the improving units; others get none.

        With gain g relative to the best one and a uniform u, the sets are { g / u >= 2^(j - 3) }: a
        unit's chance to be in a set is in proportion to its gain. Cells then receive rows in
        proportion to what they lack, and trying the sets is a line search along that direction.
        """
        if best is None or best >= -1e-15:
            return scored.selectExpr("*", "cast(null as int) as level")
        u = self._u("level", round_no, f"if(op = {self.code[SWAP]}, -1 - pair_id, row_id)")
        level = f"cast(floor(log2(change / {best!r}D) - log2({u})) as int) + 3"
        return (
            scored.selectExpr("*", f"if(change < -1e-15D, {level}, -1) as raw")
            .selectExpr("* except (raw)", f"if(raw >= 0, least(raw, {self.max_level}), null) as level")
        )

    # ---- acceptance ----

    def set_deltas(self, scored: DataFrame) -> DataFrame:
        """(key, d0..dJ): count change of every cell if all units of level >= j are applied."""
        moves = self.touched(scored.where("level is not null"), ["level"], keep_all=False)
        both = "inline(array(struct(old as key, -1L as d), struct(new as key, 1L as d)))"
        names = tuple(f"d{j}" for j in range(self.max_level + 1))
        sums = [F.expr(f"sum(if(level >= {j}, d, 0L)) as d{j}") for j in range(self.max_level + 1)]
        each = moves.selectExpr("level", both).where("key is not null").groupBy("key", "level").agg(F.sum("d").alias("d"))
        finest = each.groupBy("key").agg(*sums)  # of a row per cell and level, not per move
        key = f"shiftleft(cast(workload_id as bigint), {self.marginals.shift}) + cell as key"
        frame = self.targets.frame(scored.sparkSession)
        return self.marginals.roll_up(finest, None, names, frame, self.targets.n_workloads).selectExpr(key, *names)

    def set_changes(self, merged: DataFrame) -> DataFrame:
        """One row e0..eJ: exact change of the distance for each nested set of units."""
        n = f"{float(self.n_rows)!r}D"
        return merged.selectExpr(
            *[
                f"sum(coalesce(d{j}, 0L) / {n} * (coalesce(d{j}, 0L) / {n} - 2.0D * r)) as e{j}"
                for j in range(self.max_level + 1)
            ]
        )

    def taken(self, j: int | None) -> str:
        return "false" if j is None else f"coalesce(level >= {j}, false)"

    def apply_set(self, scored: DataFrame, j: int | None) -> DataFrame:
        """The next state: units of level >= j take their new values."""
        if j is None:
            return scored.select("row_id", "v", "b")
        take = self.taken(j)

        def new(array: str, first: str, second: str) -> str:
            slots = ", ".join(
                f"case when {take} and c1 = {i} then {first} when {take} and c2 = {i} then {second} "
                f"else get({array}, {i}) end"
                for i in range(len(self.domain.columns))
            )
            return f"array({slots}) as {array}"

        return scored.selectExpr("row_id", new("v", "x1", "x2"), new("b", "y1", "y2"))

    def apply_counts(self, merged: DataFrame, j: int | None) -> DataFrame:
        """Residuals after the accepted edits, from counts of rows removed and added."""
        if j is None:
            return merged.select("key", "r")
        return merged.selectExpr("key", f"r - coalesce(d{j}, 0L) / {float(self.n_rows)!r}D as r")
