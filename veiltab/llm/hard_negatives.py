"""Hard negatives by anchor spanning-tree bounds.

Scores are inner products of integer vectors. For each anchor its ``positives`` best other rows of the same
label are found, and for each of those the best rows of another label whose score lies in the window from
``low`` percent of the positive's score up to it.

1. Anchors are sorted by a code of random hyperplanes and cut into blocks of at most ``BLOCK``; a task joins
   the anchors of a block by a minimum spanning tree over their distances.
2. All rows are held against the blocks in batches. The root of a tree is scored exactly. On the way down, a
   row's score at a child lies within its score (or bounds) at the parent plus or minus the length of the
   edge times the row's norm. Only rows whose bounds overlap what is asked are scored again, which makes
   their bounds exact for the anchors below.
3. The first pass asks for the best rows of the anchor's label: bounds above the best of the lower bounds. The
   second asks for rows of other labels whose bounds overlap the windows of the anchor's positives. Each
   batch gives at most so many rows per anchor (and window) as can be among the best in all.

Trees go to the tasks by broadcast, ``SENT_BYTES`` of them at a time, so what is sent is bounded whatever the
number of anchors; a pass over the rows is made for each such part.

Defined cases: rows with a NULL label, id or vector, or with a NULL or non-finite component take no part; an
empty vector is a row of zeros, and shorter vectors have zeros at their end. Rows that repeat are rows of
their own; ties go by the smaller id, then by row. Without rows of the label, or of others, an anchor has
fewer results or none. An empty table, or one without anchors, gives no rows. Products of 2^53 or more
cannot be held exactly: they are refused with an error. Other columns are not read; texts don't occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veiltab.llm.shared import plain, workspace
from veiltab.llm.text import mix

BLOCK = 512  # anchors of a tree
PLANES = 16
SENT_BYTES = 32 << 20
EXACT = 1 << 53
SLACK = 1e-9  # of a bound, for rounding
TREE = "size int, ids binary, labels binary, parents binary, edges binary, vectors binary"
BEST = "anchor long, id long, row long, score long"


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the rows, parents first; the place of each one's parent in that order (-1: the root); lengths of the edges."""
    n = len(vectors)
    norms = (vectors * vectors).sum(axis=1)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    left = np.ones(n, bool)
    near, by = np.full(n, np.inf), np.zeros(n, np.int64)
    now = 0
    for k in range(n):
        order[k] = now
        left[now] = False
        apart = np.maximum(norms + norms[now] - 2 * (vectors @ vectors[now]), 0)
        closer = left & (apart < near)
        near[closer], by[closer] = apart[closer], k
        if k + 1 < n:
            now = int(np.flatnonzero(left)[near[left].argmin()])
            parent[k + 1], edge[k + 1] = by[now], np.sqrt(near[now])
    return order, parent, edge


class Scores:
    """Bounds of the scores of a batch at the anchors of a tree, tightened where they are asked for."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray):
        self.vectors, self.anchors, self.parents, self.edges = vectors, anchors, parents, edges
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.last_child = np.full(len(anchors), -1)
        np.maximum.at(self.last_child, parents[parents >= 0], np.flatnonzero(parents >= 0))
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of anchors that still have children to come
        self.scored = 0

    def visit(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds at anchor k; its parent has been visited. They may be tightened in place."""
        up = int(self.parents[k])
        if up < 0:
            low = self.vectors @ self.anchors[k]
            high = low.copy()
            self.scored += len(low)
        else:
            wide = self.norms * (self.edges[k] * (1 + SLACK)) + 1e-3
            low, high = (x + s * wide for x, s in zip(self.open[up], (-1, 1)))
            if self.last_child[up] == k:
                del self.open[up]
        if self.last_child[k] >= 0:
            self.open[k] = (low, high)
        return low, high

    def exact(self, k: int, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Scores of the rows ``which``, set as both bounds."""
        found = self.vectors[which] @ self.anchors[k]
        low[which] = high[which] = found
        self.scored += len(which)
        return found


def best_of(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n largest scores; ties by smaller id, then row."""
    if len(score) > n:  # only those that reach the n-th largest need sorting
        near = np.flatnonzero(score >= np.partition(score, len(score) - n)[len(score) - n])
    else:
        near = np.arange(len(score))
    return near[np.lexsort((rows[near], ids[near], -score[near]))[:n]]


def positives_of(found: Scores, k: int, own: np.ndarray, ids: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows among ``own`` (numbers) that may be the n best at anchor k, and their scores."""
    low, high = found.visit(k)
    if len(own) > n:
        reach = np.partition(low[own], len(own) - n)[len(own) - n]
        own = own[high[own] >= reach]
    score = found.exact(k, own, low, high)
    pick = best_of(score, ids[own], rows[own], n)
    return own[pick], score[pick]


def negatives_of(
    found: Scores, k: int, other: np.ndarray, windows: list[tuple[float, float]], ids: np.ndarray, rows: np.ndarray, n: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (lowest and highest score) the n best rows among ``other`` (marks) at anchor k, and their scores."""
    low, high = found.visit(k)
    near = np.zeros(len(low), bool)
    for least, most in windows:
        near |= (high >= least) & (low <= most)
    own = np.flatnonzero(near & other)
    score = found.exact(k, own, low, high)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        pick = inside[best_of(score[inside], ids[own[inside]], rows[own[inside]], n)]
        out.append((own[pick], score[pick]))
    return out


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, zeros at the end of shorter ones."""
    at, flat = col.offsets.to_numpy().astype(np.int64), col.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    out = np.zeros((len(col), width))
    out[np.repeat(np.arange(len(col)), size), np.arange(at[-1] - at[0]) - np.repeat(at[:-1] - at[0], size)] = flat[at[0] : at[-1]]
    return out


def prepare(df: DataFrame, anchor: Column, ws, key: str, vector: str, label: Column | str) -> tuple[DataFrame, int]:
    """(row, id, label, vector, anchor) of the rows that take part, written; the longest vector."""
    rows = plain(df, id=F.col(f"`{key}`").cast("long"), label=label, vector=F.col(f"`{vector}`").cast("array<double>"), anchor=anchor)
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(~odd)
    rows = rows.withColumn("label", F.xxhash64("label")).withColumn("anchor", F.coalesce("anchor", F.lit(False)))
    rows = ws.write(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    of = rows.agg(F.max(F.size("vector")).alias("width"), F.max(square).alias("most")).first()
    if (of["most"] or 0) >= EXACT:
        raise ValueError("inner products of 2^53 or more cannot be held exactly; scale the vectors down")
    return rows, of["width"] or 0


def trees(rows: DataFrame, width: int, ws) -> DataFrame:
    """Blocks of anchors as spanning trees, written; ``part`` numbers what is sent at a time."""
    planes = (mix(np.arange(PLANES * max(width, 1), dtype=np.uint64)) >> np.uint64(11)).astype(np.float64) / 2.0**53 - 0.5
    planes = planes.reshape(PLANES, -1)[:, :width]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = _matrix(batch.column(3), width) @ planes.T > 0
            gray = np.bitwise_xor.accumulate(side, axis=1) @ (1 << np.arange(PLANES)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(gray.astype(np.int64))], ["row", "id", "label", "vector", "code"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches):
            vectors = _matrix(batch.column(3), width)
            order, parent, edge = spanning_tree(vectors)
            ids = np.stack([batch.column(k).to_numpy()[order] for k in (0, 1)])
            made = [ids, batch.column(2).to_numpy()[order], parent, edge, vectors[order]]
            yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int32()), *(pa.array([x.tobytes()]) for x in made)], TREE_NAMES)

    anchors = rows.where("anchor").select("row", "id", "label", "vector")
    count = anchors.count()
    tasks = max(1, -(-count // (8 * BLOCK)))
    coded = anchors.mapInArrow(code, "row long, id long, label long, vector array<double>, code long")
    dealt = coded.repartitionByRange(tasks, "code", "row").sortWithinPartitions("code", "row")
    built = ws.write(dealt.mapInArrow(build, TREE).withColumn("block", F.monotonically_increasing_id()), "blocks")
    before = F.sum(F.octet_length("vectors")).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    parts = built.select("block", F.octet_length("vectors").alias("vectors")).select("block", F.floor(F.coalesce(before, F.lit(0)) / SENT_BYTES).alias("part"))
    return ws.write(built.join(parts, "block"), "trees")


TREE_NAMES = ["size", "ids", "labels", "parents", "edges", "vectors"]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of exactly BLOCK rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = BLOCK - sum(b.num_rows for b in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(b.num_rows for b in held) == BLOCK:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


def _unpacked(row, width: int):
    ids = np.frombuffer(row["ids"], np.int64).reshape(2, -1)
    labels, parents = (np.frombuffer(row[c], np.int64) for c in ("labels", "parents"))
    return ids[0], ids[1], labels, parents, np.frombuffer(row["edges"]), np.frombuffer(row["vectors"]).reshape(row["size"], width)


def search(rows: DataFrame, own: DataFrame, width: int, ws, name: str, columns: str, ask: Callable) -> DataFrame:
    """``ask(scores, k, tree, batch)`` for each anchor k of each tree over each batch of rows; it yields (columns)."""
    spark, parts = rows.sparkSession, [r["part"] for r in own.select("part").distinct().orderBy("part").collect()]
    made = spark.createDataFrame([], columns)
    names = [f.name for f in made.schema.fields]
    for part in parts:
        sent = spark.sparkContext.broadcast(own.where(F.col("part") == part).collect())  # SENT_BYTES and one block at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, ids, labels = (batch.column(k).to_numpy() for k in range(3))
                vectors = _matrix(batch.column(3), width)
                for held in sent.value:
                    tree = _unpacked(held, width)
                    scores = Scores(vectors, tree[5], tree[3], tree[4])
                    found = [f for k in range(held["size"]) for f in ask(scores, k, held, tree, (row, ids, labels))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names)

        found = rows.select("row", "id", "label", "vector").mapInArrow(run, columns)
        made = made.union(ws.write(found, f"{name}{part}"))
    return made


def mine(
    df: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 5, low: int = 80,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` marks the anchors; vectors hold whole numbers. A negative has another label than the anchor and
    low * positive_score <= 100 * negative_score <= 100 * positive_score; rank counts from 1.
    """
    ws = workspace(df.sparkSession, "negatives")
    rows, width = prepare(df, anchor, ws, key, vector, label)
    own = trees(rows, width, ws)

    def ask_positives(scores, k, held, tree, batch):
        row, ids, labels = batch
        same = np.flatnonzero((labels == tree[2][k]) & (row != tree[0][k]))
        pick, score = positives_of(scores, k, same, ids, row, positives)
        if len(pick):
            yield np.full(len(pick), tree[0][k]), ids[pick], row[pick], score

    best = search(rows, own, width, ws, "same", BEST, ask_positives)
    order = [F.col("score").desc(), "id", "row"]
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*order))
    # every batch gave so many at most, so an anchor has that times the batches
    best = ws.write(best.withColumn("place", place).where(F.col("place") <= positives), "positives")

    # the scores of an anchor's positives, at most so many, go along with its tree
    asked = best.select("anchor", "score").distinct().groupBy("anchor").agg(F.sort_array(F.collect_list("score")).alias("scores"))
    members = own.select("block", "ids").mapInArrow(_members, "block long, place int, anchor long")
    told = members.join(asked, "anchor", "left").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", F.coalesce("scores", F.array().cast("array<long>")).alias("scores")))).alias("asked")
    )
    windows = ws.write(own.join(told, "block"), "windows")

    def ask_negatives(scores, k, held, tree, batch):
        row, ids, labels = batch
        asked = held["asked"][k]["scores"]
        bounds = [(-(-low * s // 100), s) for s in asked]
        found = negatives_of(scores, k, labels != tree[2][k], bounds, ids, row, negatives)
        for s, (pick, score) in zip(asked, found):
            if len(pick):
                yield np.full(len(pick), tree[0][k]), np.full(len(pick), s), ids[pick], row[pick], score

    hard = search(rows, windows, width, ws, "other", "anchor long, positive_score long, id long, row long, score long", ask_negatives)
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(*order))
    hard = ws.write(hard.withColumn("rank", rank).where(F.col("rank") <= negatives), "negatives")
    hard = hard.select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    done = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(hard, ["anchor", "positive_score"])
    return done.join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0), batch.column(1)):
            own = np.frombuffer(ids.as_buffer(), np.int64).reshape(2, -1)[0]
            cols = [pa.array(np.full(len(own), block.as_py())), pa.array(np.arange(len(own)), pa.int32()), pa.array(own)]
            yield pa.RecordBatch.from_arrays(cols, ["block", "place", "anchor"])
