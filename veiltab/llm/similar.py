"""Groups of texts by the Jaccard similarity of their shingle sets, each link held against the sets.

1. Rows with equal sets are one unit, named by a number. Units have SimHash fingerprints.
2. The Gray-order index (``simhash``) proposes pairs: a spanning forest of the near pairs of each top node, so
   that a dense group is never paired out. A group so proposed is a tentative one.
3. Proposed pairs are joined with the shingle sets of both units, and those below the similarity go. First
   each unit's nearest pair is tested, then what still links different groups.
4. Where a tentative group fell into several, a pair that the forest left out may link them. Its units of
   different tested groups are joined by the rarest shingles of their sets, which loses no similar pair and
   makes none of units that share frequent shingles only.

So a pair links if and only if its similarity is reached, whatever the distance says; a pair is missed only if
no chain of proposed pairs joins it: it is beyond the proposed distance or in one top node of no copy.

Sets hold XXH64 of shingles: two shingles count as one with odds of 2^-64 a pair.

Defined cases: rows with equal sets, NULL and wordless ones among them, are one unit and so one group; ties
go by the unit's number; very long texts are whole, and memory follows the longest; an empty table has no
units. Rows come under names of the caller's, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.simhash import (
    SALTS, SEGMENT, SMALL, TASK_CODES, WIDE, DrawnCopies, Index, components, differ, fingerprint_words, from_binary, join_labels,
    shingle_hashes, to_binary,
)
from veiltab.llm.text import column_bytes, mix, row_chunks

ORDER_BITS = 20  # of the hash buckets that shingles are counted in
OPEN_NODES = 1 << 17  # pairs of a query and a code that a search holds at once
FEW_EDGES = 1 << 18  # edges whose components one process finds

FOUND = "a long, b long, apart int, copy int, node long, task long, part int, ids binary, codes binary"
_KINDS = {
    "a": pa.int64(), "b": pa.int64(), "apart": pa.int32(), "copy": pa.int32(), "node": pa.int64(),
    "task": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "codes": pa.binary(),
}


def _found(**cols) -> pa.RecordBatch:
    rows = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[n], k) if n in cols else pa.nulls(rows, k) for n, k in _KINDS.items()], list(_KINDS))


# ---------------------------------------------------------------- units
def fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """(row, key, code, total) of rows (row, key, text): fingerprint, and a 128-bit sum over the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(2))
            for a, b in row_chunks(bounds):
                h, at = shingle_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], shingle, True)
                total = np.zeros((b - a, 2), np.uint64)
                for k in range(2):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(h) + np.uint64(k + 1)))])
                    total[:, k] = sums[at[1:]] - sums[at[:-1]]
                own = [batch.column(k).slice(a, b - a) for k in range(2)]
                made = [*own, to_binary(fingerprint_words(h, at, WIDE)), to_binary(total)]
                yield pa.RecordBatch.from_arrays(made, ["row", "key", "code", "total"])

    return rows.select("row", "key", "text").mapInArrow(run, "row long, key long, code binary, total binary")


def sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(id, grams) of (id, text): the sorted hashes of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(1))
            for a, b in row_chunks(bounds):
                h, at = shingle_hashes(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], shingle, True)
                grams = [np.sort(h[x:y]).tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(grams, pa.binary())], ["id", "grams"])

    return texts.select("id", "text").mapInArrow(run, "id long, grams binary")


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """Of two sets without repeats; two empty ones are alike."""
    both = np.sort(np.concatenate([one, two]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared) if len(both) else 1.0


def tested(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b, linked) of pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2), batch.column(3))
            linked = [jaccard(*(np.frombuffer(x.as_buffer(), np.uint64) for x in both)) >= similarity for both in sides]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    one, two = (grams.select(F.col("id").alias(k), F.col("grams").alias(f"of_{k}")) for k in "ab")
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")
    return joined.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, linked boolean")


# ---------------------------------------------------------------- proposals
def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that unite all components of the pairs (their numbers), nearest first; the labels after it."""
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    left, picked = np.arange(len(a)), [np.zeros(0, np.int64)]
    while True:
        one, two = label[a[left]], label[b[left]]
        other = one != two
        left, one, two = left[other], one[other], two[other]
        if not len(left):
            return order[np.concatenate(picked)], label
        best = np.full(len(label), len(a), np.int64)
        np.minimum.at(best, one, left)
        np.minimum.at(best, two, left)
        pick = np.unique(best[best < len(a)])
        picked.append(pick)
        label = join_labels(label, a[pick], b[pick])


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def search_run(codes: np.ndarray, queries: np.ndarray, distance: int, step: int = 64) -> Pairs:
    """a, b, distance: near pairs of Gray-ordered codes, a forest; a code of the queries (numbers) is in each.

    Fewer queries descend at once the more codes there are, so that memory follows the codes."""
    step = max(1, min(step, OPEN_NODES // max(1, len(codes))))
    index, label, out = Index(codes), np.arange(len(codes)), [(np.zeros(0, np.int64),) * 3]
    for s in range(0, len(queries), step):
        own = queries[s : s + step]
        q, b = index.near(codes[own], label[own], label, distance)
        a = own[q]
        apart = differ(codes[a], codes[b])
        pick, label = spanning(label, a, b, apart)
        out.append((a[pick], b[pick], apart[pick]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search_runs(codes: np.ndarray, starts: np.ndarray, distance: int) -> Pairs:
    """The same for every run of codes; starts: where runs begin. Small runs are compared directly."""
    size = np.diff(np.append(starts, len(codes)))
    run = np.repeat(np.arange(len(starts)), size)
    hits = [(np.zeros(0, np.int64),) * 3]
    at = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for d in range(1, SMALL):
        at = at[at + d < len(codes)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        apart = differ(codes[at], codes[at + d])
        near = apart <= distance
        hits.append((at[near], at[near] + d, apart[near]))
    a, b, apart = (np.concatenate(x) for x in zip(*hits))
    pick, _ = spanning(np.arange(len(codes)), a, b, apart)
    out = [(a[pick], b[pick], apart[pick])]
    for k in np.flatnonzero(size > SMALL).tolist():
        s, e = starts[k], starts[k] + size[k]
        a, b, apart = search_run(codes[s:e], np.arange(size[k]), distance)
        out.append((a + s, b + s, apart))
    return tuple(np.concatenate(x) for x in zip(*out))


def proposals(units: DataFrame, copies: DrawnCopies, count: int, ws) -> DataFrame:
    """(a, b, apart): pairs of units (id, code), forests that connect all that are near in a node."""
    wide, distance, flip = copies.wide, copies.reach, np.uint64(1 << 63)  # unsigned order as signed

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = from_binary(batch.column(1), wide)
            for k in range(len(copies)):
                rank = pa.array((copies.ranks(own, k) ^ flip).view(np.int64))
                number = pa.array(np.full(len(own), k, np.int32))
                yield pa.RecordBatch.from_arrays([number, rank, batch.column(0), batch.column(1)], ["copy", "rank", "id", "code"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*(b.column(k).to_numpy() for k in range(3)), from_binary(b.column(3), wide)) for b in batches if b.num_rows]
        if not held:
            return
        copy, rank, ids, code = (np.concatenate(x) for x in zip(*held))
        held.clear()  # the batches go before the search begins
        task = TaskContext.get().partitionId()
        node = (rank.view(np.uint64) ^ flip) >> (np.uint64(64) - np.asarray(copies.head, np.uint64)[copy])
        starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (copy[1:] != copy[:-1])))
        a, b, apart = search_runs(code, starts, distance)
        if len(a):
            yield _found(a=ids[a], b=ids[b], apart=apart)
        ends = np.append(starts[1:], len(ids))
        for k in sorted({0, len(starts) - 1}):  # the node may go on in a neighbouring task
            for part, s in enumerate(range(starts[k], ends[k], SEGMENT)):
                e = min(s + SEGMENT, ends[k])
                own = {"ids": ids[s:e], "codes": code[s:e]}
                yield _found(
                    copy=[int(copy[s])], node=[int(node[s])], task=[task], part=[part], **{n: [x.tobytes()] for n, x in own.items()}
                )

    tasks = max(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(copies) // TASK_CODES))
    rows = units.select("id", "code").mapInArrow(spread, "copy int, rank long, id long, code binary")
    found = ws.write(rows.repartitionByRange(tasks, "copy", "rank").sortWithinPartitions("copy", "rank").mapInArrow(search, FOUND), "proposed")
    inner = found.where("codes is null").select("a", "b", "apart")
    return inner.union(_between(found.where("codes is not null"), wide, distance))


def _between(segments: DataFrame, wide: int, distance: int) -> DataFrame:
    """The same between segments of one node that lie in different tasks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4))):
                ids, codes, ids2, codes2 = (x.as_buffer() for x in row)
                ids, ids2 = (np.frombuffer(x, np.int64) for x in (ids, ids2))
                codes, codes2 = (np.frombuffer(x, np.uint64).reshape(-1, wide) for x in (codes, codes2))
                both = np.concatenate([ids, ids2])
                a, b, apart = search_run(np.concatenate([codes, codes2]), np.arange(len(ids), len(both)), distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(both[a]), pa.array(both[b]), pa.array(apart, pa.int32())], ["a", "b", "apart"])

    held = ["ids", "codes"]
    salt = F.pmod(F.xxhash64("task", "part"), F.lit(SALTS)).cast("int")
    left = segments.select("copy", "node", "task", *held, salt.alias("salt"))
    right = segments.select(
        "copy", "node", F.col("task").alias("task2"), *(F.col(c).alias(f"{c}2") for c in held),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    pairs = left.join(right, ["copy", "node", "salt"]).where(F.col("task") < F.col("task2"))
    return pairs.select(*held, *(f"{c}2" for c in held)).mapInArrow(compare, "a long, b long, apart int")


# ---------------------------------------------------------------- pairs by rare shingles
def gram_counts(units: DataFrame) -> np.ndarray:
    """How often the shingles of each of 2^ORDER_BITS hash buckets occur in the sets of units (..., grams)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            col = batch.column(0)
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1] // 8 if len(col) else [0, 0]
            if at[-1] > at[0]:
                total += np.bincount(_bucket(np.frombuffer(col.buffers()[2], np.uint64, int(at[-1] - at[0]), int(at[0]) * 8)), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    got = units.select("grams").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row per bucket
    out = np.zeros(1 << ORDER_BITS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def sharing_rare_grams(units: DataFrame, similarity: float) -> DataFrame:
    """(a, b, apart): units (id, of, label, grams) of one ``of`` and different labels that can be similar.

    Each set is ordered by the count of its shingles' buckets, rarest first. Of two sets of a similarity of at
    least t, the first |x| - ceil(2t / (1 + t) |x|) + 1 shingles of the shorter and the first
    |y| - ceil(t |y|) + 1 of the longer one have one in common, and |x| >= t |y|: no pair is lost. ``apart``
    is smaller the more of them they share.
    """
    counts = gram_counts(units)
    names = ["of", "gram", "id", "label", "size", "place"]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for of, i, label, grams in zip(*(batch.column(k) for k in range(4))):
                own = np.frombuffer(grams.as_buffer(), np.uint64)
                size = len(own)
                if not size:
                    continue
                order = np.lexsort((own, counts[_bucket(own)]))[: size - math.ceil(similarity * size - 1e-9) + 1]
                rows = len(order)
                parts.append((np.full(rows, of.as_py()), own[order].view(np.int64), np.full(rows, i.as_py()), np.full(rows, label.as_py()), np.full(rows, size), np.arange(rows)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts)], names)

    rows = units.select("of", "id", "label", "grams").mapInArrow(first, ", ".join(f"{n} long" for n in names))
    shared = 2 * similarity / (1 + similarity)
    short = rows.where(F.col("place") < F.col("size") - F.ceil(shared * F.col("size") - 1e-9) + 1)
    short = short.select("of", "gram", F.col("id").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"))
    long = rows.select("of", "gram", F.col("id").alias("b"), F.col("label").alias("label_b"), F.col("size").alias("size_b"))
    fits = (F.col("label_a") != F.col("label_b")) & (F.col("size_a") >= similarity * F.col("size_b") - 1e-9)
    once = F.struct("size_a", "a") < F.struct(F.col("size_b"), F.col("b"))
    pairs = short.join(long, ["of", "gram"]).where(fits & once)
    return pairs.groupBy("a", "b").agg((-F.count(F.lit(1))).cast("int").alias("apart"))


# ---------------------------------------------------------------- groups
def roots_of(edges: DataFrame, ws) -> DataFrame:
    """(node, root) as ``components`` gives them; few edges are joined in one process."""
    if edges.count() > FEW_EDGES:
        return components(edges, ws)
    got = edges.select("a", "b").toArrow()
    a, b = got.column("a").to_numpy(), got.column("b").to_numpy()
    ids, at = np.unique(np.concatenate([a, b]).astype(np.int64), return_inverse=True)
    label = join_labels(np.arange(len(ids)), at[: len(a)], at[len(a) :])
    made = pa.table({"node": pa.array(ids, pa.int64()), "root": pa.array(ids[label], pa.int64())})
    return ws.write(ws.spark.createDataFrame(made, "node long, root long"), "joined")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b, apart) whose units are not in one group yet."""
    one, two = (roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    joined = pairs.join(one, "a", "left").join(two, "b", "left")
    return joined.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b", "apart")


class Groups:
    """Groups of units over tested pairs, and all pairs that were tested."""

    def __init__(self, grams: DataFrame, similarity: float, ws):
        self.grams, self.similarity, self.ws = grams, similarity, ws
        self.pairs = ws.write(ws.spark.createDataFrame([], "a long, b long, linked boolean"), "tested")
        self.roots = ws.write(ws.spark.createDataFrame([], "node long, root long"), "roots")

    def test(self, pairs: DataFrame) -> None:
        new = tested(pairs, self.grams, self.similarity)
        self.pairs = self.ws.write(self.pairs.union(new), "tested")
        self.roots = self.ws.write(roots_of(self.pairs.where("linked"), self.ws), "roots")

    def settle(self, pairs: DataFrame) -> None:
        """Test pairs (a, b, apart): of each unit the nearest, then all that still link different groups."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").distinct()
        new = self.ws.write(_apart(pairs.join(self.pairs, ["a", "b"], "left_anti"), self.roots), "pending")
        sides = new.union(new.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
        best = sides.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("to")).select("a", F.col("to.b").alias("b"))
        self.test(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        rest = self.ws.write(_apart(new.join(self.pairs, ["a", "b"], "left_anti"), self.roots), "rest")
        if rest.take(1):
            self.test(rest)


def unit_roots(units: DataFrame, rows: DataFrame, similarity: float, shingle: int, count: int, ws) -> DataFrame:
    """(node, root): units (id, code, row) that are similar to another, with the smallest unit of their group."""
    copies = DrawnCopies(similarity, count)
    pairs = ws.write(proposals(units, copies, count, ws), "pairs")
    tentative = ws.write(roots_of(pairs, ws), "tentative")  # has every unit that any search can propose
    texts = units.join(tentative.select(F.col("node").alias("id")), "id").select("id", "row").join(rows.select("row", "text"), "row")
    groups = Groups(ws.write(sets(texts, shingle), "sets"), similarity, ws)
    groups.settle(pairs)
    own = tentative.join(groups.roots.withColumnRenamed("root", "label"), "node", "left")
    own = ws.write(own.select(F.col("node").alias("id"), F.col("root").alias("of"), F.coalesce("label", "node").alias("label")), "own")
    split = own.groupBy("of").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l < h").select("of")
    open_units = ws.write(own.join(split, "of").join(groups.grams, "id").select("id", "of", "label", "grams"), "open")
    groups.settle(ws.write(sharing_rare_grams(open_units, similarity), "shared"))
    return groups.roots
