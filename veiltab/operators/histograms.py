"""Bin edges, noisy histograms and quantiles."""

from __future__ import annotations

import math
from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veiltab.functions.literals import array_sql, small_table
from veiltab.functions.bins import add_bins
from veiltab.functions.budget import sigma_of
from veiltab.functions.hashing import gaussian, laplace
from veiltab.functions.ranking import bucket_count
from veiltab.operators.domain import CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, linspace
from veiltab.session import Workspace

MIN_MASS = 1e-9


def default_edges(domain_frame: DataFrame, depth: int) -> DataFrame:
    """(col, i, edge): 2^depth even points for continuous columns, one per value for ordinals."""
    d = domain_frame.where(F.col("role") != CATEGORICAL)
    n = F.when(F.col("role") == CONTINUOUS, F.lit(2**depth)).otherwise(F.col("size") + 1)
    top = F.when(F.col("role") == CONTINUOUS, F.lit(1.0)).otherwise(F.col("size").cast("double"))
    return d.select("col", n.alias("n"), top.alias("top")).select(
        "col", "n", "top", F.explode(F.expr("sequence(0L, n - 1)")).alias("i")
    ).select("col", "i", (F.col("i") * F.col("top") / (F.col("n") - 1)).alias("edge"))


def dyadic_edges(domain: Domain, height: int) -> dict[str, list[tuple[float, ...]]]:
    """Per column one edge list per level: level h halves level h-1. Categories have one level."""
    out = {}
    for c in domain.columns:
        if c.role == CATEGORICAL:
            out[c.name] = [tuple(float(i) for i in range(c.size + 1))]
            continue
        top = c.range[1]
        h = height if c.role == CONTINUOUS else max(1, min(int(math.log2(c.size) + 1), height))
        out[c.name] = [linspace(0.0, top, 2 ** (i + 1) + 1) for i in range(h)]
    return out


def dyadic_edge_table(domain_frame: DataFrame, height: int) -> DataFrame:
    """(col, level, i, edge) of the tree for every column, generated from the domain table."""
    d = domain_frame.select(
        "col",
        F.when(F.col("role") == CONTINUOUS, F.lit(1.0)).otherwise(F.col("size").cast("double")).alias("top"),
        F.when(F.col("role") == CATEGORICAL, F.lit(1))
        .when(F.col("role") == ORDINAL, F.least(F.floor(F.log2("size") + 1), F.lit(height)))
        .otherwise(F.lit(height))
        .cast("int")
        .alias("h"),
        "role",
    )
    lev = d.select("*", F.explode(F.expr("sequence(0, h - 1)")).alias("level"))
    n = F.when(F.col("role") == CATEGORICAL, F.col("top").cast("long")).otherwise(
        F.pow(F.lit(2.0), F.col("level") + 1).cast("long")
    )
    grid = lev.withColumn("n", n).select("*", F.explode(F.expr("sequence(0L, n)")).alias("i"))
    return grid.select("col", "level", "i", (F.col("i") * F.col("top") / F.col("n")).alias("edge"))


# ---- long-form counting --------------------------------------------------------------------


def value_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """(col, x) of the given numeric columns, NULLs left out."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("col"), F.col(n).cast("double").alias("x")) for n in names]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*").where("x is not null")


def bin_counts(df: DataFrame, edges: dict[str, list[float]], outside: bool = False) -> DataFrame:
    """(col, bin, cnt) of all columns in one grouped count."""
    binned = add_bins(df.select(*edges), {f"b_{n}": (n, list(e)) for n, e in edges.items()}, outside)
    pairs = F.array(*[F.struct(F.lit(n).alias("col"), F.col(f"b_{n}").alias("bin")) for n in edges])
    return (
        binned.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .where("bin is not null")
        .groupBy("col", "bin")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def bin_grid(spark: SparkSession, sizes: dict[str, int]) -> DataFrame:
    """Every (col, bin), empty or not."""
    d = small_table(spark, list(sizes.items()), "col string, n int")
    return d.select("col", F.explode(F.expr("sequence(0, n - 1)")).alias("bin"))


def clip01(x: C) -> C:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def rescale(df: DataFrame, mass: C, group: list[str], n_bins: C) -> DataFrame:
    """Scale ``stat`` so that every group sums to ``mass``; spread evenly if nothing is left."""
    total = F.sum("stat").over(W.partitionBy(*group))
    even = mass / n_bins
    return df.withColumn(
        "stat", F.when(total < MIN_MASS, even).otherwise(mass * F.col("stat") / total)
    )


def noisy_histogram(
    df: DataFrame, edges: dict[str, list[float]], n_rows: int, sigma: float | None, seed, mass: float = 1.0
) -> DataFrame:
    """(col, bin, cnt, stat): density plus noise, clipped to [0,1] and rescaled to ``mass``."""
    sizes = {n: len(e) - 1 for n, e in edges.items()}
    full = bin_grid(df.sparkSession, sizes).join(bin_counts(df, edges), ["col", "bin"], "left")
    cnt = F.coalesce("cnt", F.lit(0)).cast("long")
    stat = cnt / F.lit(float(n_rows))
    if sigma:
        stat = stat + F.lit(sigma) * gaussian(seed, "histogram", F.col("col"), F.col("bin"))
    full = full.select("col", "bin", cnt.alias("cnt"), clip01(stat).alias("stat"))
    n = F.count(F.lit(1)).over(W.partitionBy("col"))
    return rescale(full, F.lit(float(mass)), ["col"], n)


def noisy_categories(df: DataFrame, domain: Domain, names: list[str], n_rows: int, rho: float | None, seed) -> DataFrame:
    """(col, label, stat): one-level histogram of label columns with noise, not clipped."""
    sigma = sigma_of(math.sqrt(2.0) / n_rows, rho)
    pairs = F.array(*[F.struct(F.lit(n).alias("col"), F.col(n).cast("int").alias("label")) for n in names])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("col", "label")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    grid = bin_grid(df.sparkSession, {n: domain[n].size for n in names}).withColumnRenamed("bin", "label")
    full = grid.join(counts, ["col", "label"], "left")
    noise = F.lit(sigma) * gaussian(seed, "categories", F.col("col"), F.col("label"))
    stat = F.coalesce("cnt", F.lit(0)) / F.lit(float(n_rows)) + noise
    return full.select("col", "label", stat.alias("stat"))


# ---- adaptive private edges ----------------------------------------------------------------


def tree_height(col: Column, k: int, granularity: float) -> int:
    """Halvings until an interval is as small as the spacing of the data, at least one."""
    span = col.range[1] - col.range[0]
    step = 1.0 if col.role == ORDINAL else granularity
    return max(1, int(math.log2(span / k / step) + 1)) if span / k / step > 0 else 1


def adaptive_histogram(
    df: DataFrame, domain: Domain, names: list[str], n_rows: int, rho: float | None, k: int = 64,
    granularity: float = 0.001, seed=0,
) -> DataFrame:
    """(col, lo, hi, stat): noisy histogram whose bins are halved while they hold more than 1/k.

    The rows are counted once, at the deepest level, for all columns together. Each level then adds
    up leaf counts of the nodes being split, of which there are at most k per column.
    """
    spark = df.sparkSession
    heights = {n: tree_height(domain[n], k, granularity) for n in names}
    pairs = []
    for n in names:
        lo, hi = domain[n].range
        leaves = k * 2 ** heights[n]
        leaf = F.floor((F.col(n) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(leaves)))
        leaf = F.greatest(F.lit(0), F.least(F.lit(leaves - 1), leaf)).cast("long")
        pairs.append(F.struct(F.lit(n).alias("col"), leaf.alias("leaf")))
    leaves = (
        df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").where("leaf is not null")
        .groupBy("col", "leaf").agg(F.count(F.lit(1)).alias("cnt"))
    )
    meta_rows = []
    for n in names:
        lo, hi = domain[n].range
        step = 1.0 if domain[n].role == ORDINAL else granularity
        sigma = sigma_of(math.sqrt(2.0 * (heights[n] + 1)) / n_rows, rho)
        meta_rows.append((n, lo, hi, heights[n], step, sigma))
    meta = small_table(spark, meta_rows, "col string, lo double, hi double, height int, step double, sigma double"
    )

    def noised(nodes: DataFrame, level: int, stat: C) -> DataFrame:
        """Set ``stat`` of the new nodes to their clipped noisy share at ``level``."""
        up = F.floor(F.col("leaf") / F.pow(F.lit(2.0), F.col("height") - level)).cast("long")
        sums = (
            leaves.join(F.broadcast(meta.select("col", "height")), "col")
            .groupBy("col", up.alias("node")).agg(F.sum("cnt").alias("cnt"))
        )
        share = F.coalesce("cnt", F.lit(0)) / F.lit(float(n_rows)) + F.col("sigma") * gaussian(
            seed, "edges", F.col("col"), F.lit(level), F.col("node")
        )
        joined = nodes.join(sums, ["col", "node"], "left")
        return joined.withColumn("stat", F.when(F.col("fresh"), clip01(share)).otherwise(stat)).drop("cnt")

    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<long>"))
    nodes = meta.select("*", every.alias("node"), F.lit(0).alias("level"), F.lit(True).alias("fresh"))
    nodes = rescale(noised(nodes, 0, F.lit(None)), F.lit(1.0), ["col"], F.lit(k))
    # Finished nodes travel along unchanged, so the plan is one chain of small joins.
    for level in range(max(heights.values())):
        width = (F.col("hi") - F.col("lo")) / F.lit(float(k * 2**level))
        split = (
            F.col("fresh") & (F.col("stat") > 1.0 / k) & (width > F.col("step")) & (F.col("height") > level)
        )
        nodes = nodes.withColumn("fresh", split).select(
            *meta.columns, "fresh", F.col("stat").alias("mass"), F.col("node").alias("parent"),
            F.col("level").alias("parent_level"),
            F.when(split, F.lit(level + 1)).otherwise(F.col("level")).alias("level"),
            F.explode(
                F.when(split, F.array(F.col("node") * 2, F.col("node") * 2 + 1)).otherwise(F.array("node"))
            ).alias("node"),
        )
        nodes = noised(nodes, level + 1, F.col("mass"))
        n_siblings = F.when(F.col("fresh"), F.lit(2)).otherwise(F.lit(1))
        nodes = rescale(nodes, F.col("mass"), ["col", "parent_level", "parent"], n_siblings)
        nodes = nodes.drop("mass", "parent", "parent_level")
    width = (F.col("hi") - F.col("lo")) / (F.lit(float(k)) * F.pow(F.lit(2.0), F.col("level")))
    left = F.col("lo") + F.col("node") * width
    return nodes.select("col", left.alias("left"), (left + width).alias("right"), "stat")


def equal_mass_edges(histogram: DataFrame, k: int = 64) -> DataFrame:
    """(col, i, edge): k quantiles of a piecewise-uniform density, by inverting its CDF.

    Each interval knows which quantiles fall into it, so nothing is joined. The window runs over one
    column's intervals, whose number is bounded by the edge tree, not by the table.
    """
    order = W.partitionBy("col").orderBy("left")
    cum = F.sum("stat").over(order.rowsBetween(W.unboundedPreceding, 0))
    h = histogram.withColumn("cum", cum)
    h = h.withColumn("total", F.max("cum").over(W.partitionBy("col")))
    h = h.withColumn("hi_q", F.col("cum") / F.col("total"))
    h = h.withColumn("lo_q", F.coalesce(F.lag("hi_q").over(order), F.lit(0.0)))
    last = F.lit(k - 1)
    first_i = F.ceil(F.col("lo_q") * last)
    end_i = F.when(F.col("hi_q") >= 1.0, F.lit(k)).otherwise(F.ceil(F.col("hi_q") * last))
    h = h.where("hi_q > lo_q").withColumn("a", first_i).withColumn("z", end_i).where("z > a")
    h = h.select("*", F.explode(F.expr("sequence(a, z - 1)")).alias("i"))
    t = (F.col("i") / last - F.col("lo_q")) / (F.col("hi_q") - F.col("lo_q"))
    edge = F.col("left") + t * (F.col("right") - F.col("left"))
    return h.select("col", F.col("i").cast("long").alias("i"), edge.alias("edge"))


def private_edges(
    df: DataFrame, domain: Domain, names: list[str], n_rows: int, rho_per_column: float | None,
    k: int = 64, granularity: float = 0.001, seed=0,
) -> dict[str, list[float]]:
    """Private equal-mass edges of all columns: k numbers per column reach the driver."""
    if not names:
        return {}
    h = adaptive_histogram(df, domain, names, n_rows, rho_per_column, k, granularity, seed)
    out: dict[str, list[float]] = {n: [] for n in names}
    for r in equal_mass_edges(h, k).orderBy("col", "i").collect():  # k rows per column
        out[r["col"]].append(r["edge"])
    return out


def tree_quantiles(stats: DataFrame, domain_top: float, height: int, q: int) -> DataFrame:
    """(i, edge): cut points of about 1/q mass from noisy dyadic statistics (level, bin, stat) of one column.

    A cut at leaf edge a is followed by one at the first later edge j with mass(j + 1) - mass(a) > 1/q; edge 0 is
    always one. Noisy masses need not rise, so each edge finds its successor in maxima of dyadic blocks: the
    first block after it that goes high enough, then the first half of that, and so on. Pointers are doubled
    by self-joins and followed from 0.
    """
    spark, n = stats.sparkSession, 2**height
    ws = Workspace(spark, "cuts")
    mass = ws.write(prefix_mass(stats, height), "mass")
    ahead = mass.where("i > 1").selectExpr("i - 1 as j", "mass", f"explode(sequence(0, {height})) as level")
    blocks = ws.write(
        ahead.selectExpr("level", "shiftright(j, level) as block", "mass").groupBy("level", "block").agg(F.max("mass").alias("top")),
        "blocks",
    )
    start = mass.union(spark.range(1).selectExpr("id", "0D")).withColumn("need", F.col("mass") + F.lit(1.0 / q))
    tries = start.selectExpr("i", "need", f"explode(sequence(0, {height - 1})) as level")
    tries = tries.withColumn("block", F.expr("shiftright(i + shiftleft(1L, level), level)")).where("block % 2 = 1")
    at = tries.join(blocks, ["level", "block"]).where("top > need").groupBy("i").agg(
        F.expr("min(struct(shiftleft(block, level) as j, level, need))").alias("s")
    ).select("i", "s.*")
    for level in range(height - 1, 0, -1):  # a block of this level to the first of its halves that is high enough
        left = blocks.where(F.col("level") == level - 1).select(F.col("block").alias("half"), "top")
        right = F.col("top").isNull() | (F.col("top") <= F.col("need"))
        moved = F.col("j") + F.when((F.col("level") >= level) & right, F.lit(1 << (level - 1))).otherwise(0)
        at = at.join(left, F.shiftright("j", level - 1) == F.col("half"), "left").select("i", moved.alias("j"), "level", "need")
    jump = ws.write(at.select("i", "j"), "jump")
    cuts = ws.write(spark.range(1).withColumnRenamed("id", "i"), "cuts")
    for _ in range(height):  # the first 2^k cuts after k turns
        cuts = ws.write(cuts.union(cuts.join(jump, "i").select("j")), "cuts")
        jump = ws.write(jump.join(jump.selectExpr("i as j", "j as k"), "j").selectExpr("i", "k as j"), "jump")
    place = F.row_number().over(W.orderBy("i")) - 1  # at most one cut per leaf
    return cuts.select(place.alias("i"), (F.col("i") * F.lit(domain_top) / F.lit(n)).alias("edge"))


def prefix_mass(stats: DataFrame, height: int) -> DataFrame:
    """(i, mass) for the inner leaf edges 1..2^height - 1 of a dyadic tree."""
    spark = stats.sparkSession
    edges = spark.range(1, 2**height).withColumnRenamed("id", "i")
    bits = edges.select("i", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("level"))
    up = F.floor(F.col("i") / F.pow(F.lit(2.0), F.lit(height - 1) - F.col("level"))).cast("long")
    need = bits.withColumn("up", up).where("up % 2 = 1")
    need = need.select("i", "level", (F.col("up") - 1).alias("bin"))
    return need.join(stats, ["level", "bin"]).groupBy("i").agg(F.sum("stat").alias("mass"))


# ---- CDF, coverage, quantiles --------------------------------------------------------------


def cdf(df: DataFrame, thresholds: dict[str, list[float]], n_rows: int) -> DataFrame:
    """(col, threshold, stat): fraction of rows with x < threshold, by one count per interval."""
    cuts = {n: sorted(set(map(float, ts))) for n, ts in thresholds.items()}
    below = add_bins(
        df.select(*cuts), {f"b_{n}": (n, [float("-inf"), *ts, float("inf")]) for n, ts in cuts.items()}
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("col"), F.col(f"b_{n}").alias("bin")) for n in cuts])
    counts = (
        below.select(F.explode(pairs).alias("p")).select("p.*").where("bin is not null")
        .groupBy("col", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    )
    rows = [(n, i, t) for n, ts in cuts.items() for i, t in enumerate(ts)]
    asked = small_table(df.sparkSession, rows, "col string, bin int, threshold double")
    full = asked.join(counts, ["col", "bin"], "left")
    run = W.partitionBy("col").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.coalesce("cnt", F.lit(0))).over(run)
    return full.select("col", "threshold", (total / F.lit(float(n_rows))).alias("stat"))


def max_coverage(df: DataFrame, edges: dict[str, list[float]], n_rows: int) -> DataFrame:
    """(col, max_mass): the heaviest bin of every column, to compare with 1/k."""
    return (
        bin_counts(df, edges).groupBy("col")
        .agg((F.max("cnt") / F.lit(float(n_rows))).alias("max_mass"))
    )


def exact_quantiles(df: DataFrame, names: list[str], probs: list[float]) -> DataFrame:
    """(col, i, value): exact quantiles with linear interpolation.

    Approximate cut points split every column into ranges, which are counted. Only the ranges that
    hold a wanted rank are looked at value by value; equal values are merged before they are ranked,
    so a value with a third of the rows is one row.
    """
    spark = df.sparkSession
    df = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    rows = df.count()
    buckets = min(10_000, max(1024, bucket_count(rows)))
    probe = array_sql([i / buckets for i in range(1, buckets)])
    found = df.agg(
        *[F.expr(f"percentile_approx(`{n}`, {probe}, {10 * buckets}) as `{n}`") for n in names]
    ).first()
    inf = float("inf")
    edges = {n: [-inf, *sorted(set(found[n] or [])), inf] for n in names}
    sizes: dict[str, dict[int, int]] = {n: {} for n in names}
    for r in bin_counts(df, edges).collect():  # at most 10,000 counts per column
        sizes[r["col"]][r["bin"]] = r["cnt"]
    asked, wanted = [], []
    for n in names:
        total = sum(sizes[n].values())
        if total == 0:
            continue
        ranks = set()
        for i, p in enumerate(probs):
            low = int(math.floor(p * (total - 1)))
            high = min(low + 1, total - 1)
            asked.append((n, i, low, high, p * (total - 1) - low))
            ranks |= {low, high}
        before = 0
        for b in sorted(sizes[n]):
            mine = sorted(r for r in ranks if before <= r < before + sizes[n][b])
            if mine:
                wanted.append((n, b, before, mine))
            before += sizes[n][b]
    want = small_table(spark, wanted, "col string, bin int, before long, ranks array<long>")
    binned = add_bins(df, {f"b_{n}": (n, edges[n]) for n in names})
    pairs = F.array(
        *[F.struct(F.lit(n).alias("col"), F.col(f"b_{n}").alias("bin"), F.col(n).alias("x")) for n in names]
    )
    values = (
        binned.select(F.explode(pairs).alias("p")).select("p.*")
        .join(F.broadcast(want.select("col", "bin")), ["col", "bin"], "left_semi")
        .groupBy("col", "bin", "x").agg(F.count(F.lit(1)).alias("cnt"))
    )
    run = W.partitionBy("col", "bin").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = values.withColumn("hi", F.sum("cnt").over(run)).join(F.broadcast(want), ["col", "bin"])
    hit = ranked.selectExpr(
        "col", "x", "explode(filter(ranks, r -> r >= before + hi - cnt and r < before + hi)) as rank"
    )
    asked_df = small_table(spark, asked, "col string, i int, r0 long, r1 long, frac double")
    v0, v1 = hit.selectExpr("col", "rank as r0", "x as x0"), hit.selectExpr("col", "rank as r1", "x as x1")
    return asked_df.join(v0, ["col", "r0"]).join(v1, ["col", "r1"]).selectExpr(
        "col", "i", "x0 + frac * (x1 - x0) as value"
    )


def quantile_grid(df: DataFrame, domain: Domain, names: list[str], points: int = 32) -> DataFrame:
    """(col, i, value): 0, ``points`` evenly spaced quantiles, and the column's size."""
    q = exact_quantiles(df, names, list(linspace(0.0, 1.0, points)))
    ends = [(n, 0, 0.0) for n in names] + [(n, points + 1, float(domain[n].size)) for n in names]
    ends = small_table(df.sparkSession, ends, "col string, i int, value double")
    return q.withColumn("i", F.col("i") + 1).unionByName(ends)


# ---- private bounds ------------------------------------------------------------------------

# Exponents of the magnitude bins searched for private bounds.
BOUND_EXPONENTS = range(-32, 64)


def private_bounds(df: DataFrame, names: list[str], epsilon: float, seed, beta: float = 1e-9) -> DataFrame:
    """(col, lower, upper) from a noisy count of signed power-of-two magnitudes.

    Published approach: count values per magnitude bin, add Laplace noise of scale 1/epsilon and take
    the outermost bins above a threshold that pure noise exceeds with probability ``beta`` at most.
    """
    first, last = min(BOUND_EXPONENTS), max(BOUND_EXPONENTS)
    x = F.col("x")
    magnitude = F.greatest(F.lit(first), F.least(F.lit(last), F.floor(F.log2(F.abs(x))))).cast("int")
    magnitude = F.when(F.abs(x) < F.lit(2.0**first), F.lit(first)).otherwise(magnitude)
    binned = value_pairs(clean_inf(df, names), names).select(
        "col", F.when(x < 0, F.lit(-1)).otherwise(F.lit(1)).alias("sign"), magnitude.alias("e")
    )
    counts = binned.groupBy("col", "sign", "e").agg(F.count(F.lit(1)).alias("cnt"))
    spark = df.sparkSession
    grid = small_table(spark, [(n,) for n in names], "col string")
    grid = grid.select("col", F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign")).select(
        "col", "sign", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("e")
    )
    bins = 2 * len(BOUND_EXPONENTS)
    threshold = math.log(bins / (2.0 * beta)) / epsilon
    noise = laplace(seed, "bounds", F.col("col"), F.col("sign"), F.col("e")) / F.lit(epsilon)
    full = grid.join(counts, ["col", "sign", "e"], "left")
    kept = full.where(F.coalesce("cnt", F.lit(0)) + noise > threshold)
    small = F.when(F.col("e") == first, F.lit(0.0)).otherwise(F.pow(F.lit(2.0), F.col("e")))
    large = F.pow(F.lit(2.0), F.col("e") + 1)
    return kept.groupBy("col").agg(
        F.min(F.when(F.col("sign") < 0, -large).otherwise(small)).alias("lower"),
        F.max(F.when(F.col("sign") < 0, -small).otherwise(large)).alias("upper"),
    )


def clean_inf(df: DataFrame, names: list[str]) -> DataFrame:
    inf = F.lit(float("inf"))
    return df.select(
        *[F.when(~F.isnan(c) & (F.abs(c) != inf), c).alias(n) for n in names for c in [F.col(n).cast("double")]]
    )
