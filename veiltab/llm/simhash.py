"""Near-duplicates by SimHash, searched through a Gray-order hierarchical index.

1. Fingerprints: 64 bits over XXH64 of word shingles, or several such words of bits for a search by
   similarity. Equal fingerprints collapse to one code.
2. Index copies, each with another order of the bits. The leading bits of a copy are its top nodes, which
   are searched at accumulated difference 0. For a fixed distance the 64 bits are cut into blocks and a
   copy puts all but ``distance`` of them first: two codes within it agree on the leading blocks of at
   least one copy, so no link is lost. For a similarity the leading bits are drawn by hash, and there are
   as many copies as propose a pair of just that similarity with probability ``RECALL``. The number of
   leading bits grows with the logarithm of the number of codes, so that few codes meet by chance.
3. In each copy codes are sorted by Gray rank and dealt out by range, which splits large nodes too.
   A task builds the lower levels: groups of neighbours share masked bit patterns, held once by the
   node above. Queries descend all at once; a group is dropped when its accumulated difference exceeds
   the distance, or when all of it is known to be in the query's component already. So dense groups
   give a spanning forest, never all their pairs.
4. A node that crosses a border between tasks is compared segment by segment, again through the index.
5. Components of the forest: alternating large and small stars, written to shared storage each round.

A similarity is the Jaccard similarity of shingle sets. The bits only propose pairs, up to three deviations
above the mean distance of pairs of just that similarity; ``similar`` holds each against the sets themselves.

Defined cases: NULL and wordless texts have fingerprint 0 and are linked like any other; repeated rows
and ties share their fingerprint; a component is named by its smallest key, NULL keys aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veiltab.llm.shared import narrow_batches, plain, workspace
from veiltab.llm.text import column_bytes, follow, mix, row_chunks, same_as, words

FAN = 16  # children of a node
SMALL = 24  # codes of a node that are compared directly
SEGMENT = 4096  # codes of a segment that other tasks compare with
TASK_CODES = 1 << 20
SALTS = 16
NODE_CODES = 8  # random codes wanted below a top node, at most
WIDE = 4  # words of a fingerprint that is searched by similarity
RECALL = 0.99
DEVIATIONS = 3  # of the distance of similar pairs, above its mean, up to which pairs are proposed


# ---------------------------------------------------------------- fingerprints
def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Fingerprint of each row from the hashes of its shingles: the bits set in over half of them."""
    count = np.diff(at)
    some = at[:-1][count > 0]
    long = [np.arange(a, b, 65535) for a, b in zip(at[:-1], at[1:]) if b - a > 65535]
    starts = np.unique(np.concatenate([some, *long])) if long else some
    out = np.zeros(len(count), np.uint64)
    if not len(starts):
        return out
    row = np.searchsorted(at, starts, "right") - 1
    lane = np.uint64(0x0001000100010001)
    for k in range(16):  # four counters of 16 bits in each sum
        sums = np.add.reduceat((h >> np.uint64(k)) & lane, starts)
        for j in range(4):
            ones = np.bincount(row, (sums >> np.uint64(16 * j)) & np.uint64(0xFFFF), len(count))
            out |= (2 * ones > count).astype(np.uint64) << np.uint64(k + 16 * j)
    return out


def shingle_hashes(data: np.ndarray, bounds: np.ndarray, n: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of rows, and the rows' bounds; ``once``: a shingle counts once in a row."""
    raw, ends = data.tobytes(), bounds.tolist()
    texts = [b" ".join(raw[a:b].lower().split()) for a, b in zip(ends, ends[1:])]
    joined = b"".join(texts)
    own = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    starts, stops, word_at = words(np.frombuffer(joined, np.uint8), own)
    count = np.diff(word_at)
    shingles = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(word_at[:-1] - at[:-1], shingles) + np.arange(at[-1])
    last = np.minimum(first + n, np.repeat(word_at[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[first].tolist(), stops[last].tolist())
    h = np.fromiter((digest(joined[a:b], 42) for a, b in pairs), np.uint64, int(at[-1]))
    if once:
        row = np.repeat(np.arange(len(count)), shingles)
        one = same_as(follow(h, row.astype(np.uint64))) == np.arange(len(h))
        h, at = h[one], np.concatenate([[0], np.cumsum(one)])[at]
    return h, at


def fingerprint_words(h: np.ndarray, at: np.ndarray, wide: int) -> np.ndarray:
    """Fingerprints of ``wide`` words each. The first is over XXH64 itself, others over it mixed."""
    return np.stack([majority(mix(h + np.uint64(k)) if k else h, at) for k in range(wide)], axis=1)


def _fingerprint_rows(data: np.ndarray, bounds: np.ndarray, n: int, wide: int = 1) -> np.ndarray:
    """Fingerprints of rows; wide ones are of sets, as similarity is."""
    return fingerprint_words(*shingle_hashes(data, bounds, n, wide > 1), wide)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 4, wide: int = 1) -> DataFrame:
    """(key, code): A-Z lower-cased, words between ASCII white space; the words of bits as big-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = column_bytes(batch.column(1))
            for a, b in row_chunks(bounds):
                fp = _fingerprint_rows(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], shingle, wide)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), to_binary(fp)], ["key", "code"])

    return plain(docs, key=key, text=text).mapInArrow(run, "key long, code binary")


def to_binary(codes: np.ndarray) -> pa.Array:
    """Rows of words as binary values, big-endian."""
    rows, wide = codes.shape
    at = np.arange(rows + 1, dtype=np.int32) * (8 * wide)
    return pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at), pa.py_buffer(codes.astype(">u8").tobytes())])


def from_binary(col: pa.Array, wide: int) -> np.ndarray:
    if not len(col):
        return np.zeros((0, wide), np.uint64)
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset]
    raw = np.frombuffer(col.buffers()[2], ">u8", len(col) * wide, int(at))
    return raw.astype(np.uint64).reshape(-1, wide)


# ---------------------------------------------------------------- index
def block_widths(blocks: int) -> list[int]:
    return [64 // blocks + (k < 64 % blocks) for k in range(blocks)]


def gray_rank(code: np.ndarray) -> np.ndarray:
    for step in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(step))
    return code


class Copies:
    """Bit orders of the index copies for a distance: the kept blocks first, then the others."""

    def __init__(self, blocks: int, distance: int):
        width = block_widths(blocks)
        low = np.cumsum([0, *width]).tolist()
        self.distance, self.wide = distance, 1
        self.moves, self.head = [], []
        for kept in combinations(range(blocks), blocks - distance):
            order = [*kept, *(b for b in range(blocks) if b not in kept)]
            place, moves = 64, []
            for b in order:
                place -= width[b]
                moves.append((low[b], place, (1 << width[b]) - 1))
            self.moves.append(moves)
            self.head.append(sum(width[b] for b in kept))

    def __len__(self) -> int:
        return len(self.head)

    def ranks(self, codes: np.ndarray, copy: int) -> np.ndarray:
        """Gray rank of the rearranged codes (rows of one word)."""
        fp, out = codes[:, 0], np.zeros(len(codes), np.uint64)
        for low, place, mask in self.moves[copy]:
            out |= ((fp >> np.uint64(low)) & np.uint64(mask)) << np.uint64(place)
        return gray_rank(out)


class DrawnCopies:
    """Bit orders of the index copies for a similarity: each starts with bits drawn by hash."""

    def __init__(self, similarity: float, codes: int, wide: int = WIDE):
        turn = np.arccos(2 * similarity / (1 + similarity)) / np.pi  # share of bits that differ, on average
        bits = 64 * wide
        spread = np.sqrt(bits * turn * (1 - turn))
        self.distance = int(bits * turn + spread)  # up to which the bits alone would call a pair similar
        self.reach = int(bits * turn + DEVIATIONS * spread)  # up to which pairs are proposed
        self.wide = wide
        head = max(8, int(max(codes, 1) // 4).bit_length())
        apart = np.arange(self.reach + 1)
        odds = np.exp(-(((apart - bits * turn) / spread) ** 2) / 2) / (spread * np.sqrt(2 * np.pi))
        met = (1 - apart / bits) ** head  # in one copy
        many = 1
        while odds @ (1 - (1 - met) ** many) < RECALL:
            many += 1
        self.head = [head] * many
        order = mix(np.arange(many * bits, dtype=np.uint64) + np.uint64(1)).reshape(many, bits)
        self.drawn = np.argsort(order, axis=1)[:, : min(64, head + 12)]

    def __len__(self) -> int:
        return len(self.head)

    def ranks(self, codes: np.ndarray, copy: int) -> np.ndarray:
        """Gray rank of the drawn bits."""
        out = np.zeros(len(codes), np.uint64)
        for place, bit in enumerate(self.drawn[copy].tolist()):
            out |= ((codes[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)) << np.uint64(63 - place)
        return gray_rank(out)


def blocks_for(codes: int, distance: int) -> int:
    """Blocks so that a top node holds few codes that agree by chance."""
    blocks = distance + 2
    while blocks < distance + 4 and codes >> sum(block_widths(blocks)[distance:]) > NODE_CODES:
        blocks += 1
    return blocks


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Unite the components of a[i] and b[i]. Labels are the smallest index of a component."""
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def differ(a: np.ndarray, b: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Number of differing bits of rows of words."""
    x = a ^ b
    return np.bitwise_count(x if mask is None else x & mask).sum(axis=1, dtype=np.int64)


class Index:
    """Levels of groups over Gray-ordered codes. A node holds the bits its codes share and its parent lacks."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        both, either = codes, codes
        self.levels: list[list[np.ndarray]] = []
        while len(both) > FAN or not self.levels:
            at = np.arange(0, len(both), FAN)
            both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
            self.levels.append([~(both ^ either), both])  # mask of the shared bits, their values
        self.levels.reverse()
        full = self.levels[0][0]  # all bits known down to a level
        for low in self.levels[1:]:
            above = np.repeat(full, FAN, axis=0)[: len(low[0])]
            full, low[0] = low[0], low[0] & ~above
        self.leaf_mask = ~np.repeat(full, FAN, axis=0)[: len(codes)]

    def same_label(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level the label all codes of a node have, or -1."""
        low = high = label
        out = []
        for _ in self.levels:
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        return out[::-1]

    def near(self, query: np.ndarray, own: np.ndarray, label: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, code number) of links to codes that carry another label than ``own``."""
        top = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(query)), top), np.tile(np.arange(top), len(query))
        apart = np.zeros(len(q), np.int64)
        stages = [*zip((x[0] for x in self.levels), (x[1] for x in self.levels), self.same_label(label)), (self.leaf_mask, self.codes, label)]
        for level, (mask, value, same) in enumerate(stages):
            if level:
                q, apart, node = np.repeat(q, FAN), np.repeat(apart, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(mask)
                q, apart, node = q[real], apart[real], node[real]
            other = same[node] != own[q]
            q, apart, node = q[other], apart[other], node[other]
            apart = apart + differ(query[q], value[node], mask[node])
            go = apart <= distance
            q, apart, node = q[go], apart[go], node[go]
        return q, node


def forest(codes: np.ndarray, distance: int, queries: np.ndarray | None = None, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among Gray-ordered codes; only links of ``queries`` (numbers) if given."""
    index, label = Index(codes), np.arange(len(codes))
    queries = np.arange(len(codes)) if queries is None else queries
    for a in range(0, len(queries), step):
        own = queries[a : a + step]
        q, leaf = index.near(codes[own], label[own], label, distance)
        label = join_labels(label, own[q], leaf)
    child = np.flatnonzero(label != np.arange(len(codes)))
    return child, label[child]


def run_links(codes: np.ndarray, starts: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all codes within ``distance`` in each run; starts: where runs begin."""
    size = np.diff(np.append(starts, len(codes)))
    run = np.repeat(np.arange(len(starts)), size)
    a_all, b_all = [], []
    at = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL), size))
    for d in range(1, SMALL):
        at = at[at + d < len(codes)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        hit = at[differ(codes[at], codes[at + d]) <= distance]
        a_all.append(hit)
        b_all.append(hit + d)
    for k in np.flatnonzero(size > SMALL).tolist():
        a, b = forest(codes[starts[k] : starts[k] + size[k]], distance)
        a_all.append(a + starts[k])
        b_all.append(b + starts[k])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a_all]), np.concatenate([none, *b_all])


FOUND = "a long, b long, copy int, node long, task long, part int, ids binary, codes binary"


def links(codes: DataFrame, copies: Copies | DrawnCopies, count: int, ws) -> DataFrame:
    """(a, b): links between different codes (id, code) that connect all that are near."""
    wide, distance = copies.wide, copies.distance
    flip = np.uint64(1 << 63)  # unsigned order as signed

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
        task = TaskContext.get().partitionId()
        node = (rank.view(np.uint64) ^ flip) >> (np.uint64(64) - np.asarray(copies.head, np.uint64)[copy])
        starts = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (copy[1:] != copy[:-1])))
        a, b = run_links(code, starts, distance)
        if len(a):
            yield _found(a=ids[a], b=ids[b])
        ends = np.append(starts[1:], len(ids))
        for k in sorted({0, len(starts) - 1}):  # the node may go on in a neighbouring task
            for part, s in enumerate(range(starts[k], ends[k], SEGMENT)):
                e = min(s + SEGMENT, ends[k])
                yield _found(
                    copy=[int(copy[s])], node=[int(node[s])], task=[task], part=[part], ids=[ids[s:e].tobytes()], codes=[code[s:e].tobytes()]
                )

    tasks = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * len(copies) // TASK_CODES))
    rows = codes.select("id", "code").mapInArrow(spread, "copy int, rank long, id long, code binary")
    found = ws.write(rows.repartitionByRange(tasks, "copy", "rank").sortWithinPartitions("copy", "rank").mapInArrow(search, FOUND), "found")
    inner = found.where("codes is null").select("a", "b")
    return inner.union(_between(found.where("codes is not null"), wide, distance)).distinct()


def _found(**cols) -> pa.RecordBatch:
    kinds = {"copy": pa.int32(), "part": pa.int32(), "ids": pa.binary(), "codes": pa.binary()}
    rows = len(next(iter(cols.values())))
    names = ["a", "b", "copy", "node", "task", "part", "ids", "codes"]
    made = [pa.array(cols[n], kinds.get(n, pa.int64())) if n in cols else pa.nulls(rows, kinds.get(n, pa.int64())) for n in names]
    return pa.RecordBatch.from_arrays(made, names)


def _between(segments: DataFrame, wide: int, distance: int) -> DataFrame:
    """Links between segments of one node that lie in different tasks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4))):
                ids, codes, ids2, codes2 = (np.frombuffer(x.as_buffer(), np.uint64) for x in row)
                codes = np.concatenate([codes2, codes]).reshape(-1, wide)
                ids = np.concatenate([ids2, ids]).view(np.int64)
                a, b = forest(codes, distance, np.arange(len(ids2), len(ids)))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    salt = F.pmod(F.xxhash64("task", "part"), F.lit(SALTS)).cast("int")
    left = segments.select("copy", "node", "task", "ids", "codes", salt.alias("salt"))
    right = segments.select(
        "copy", "node", F.col("task").alias("task2"), F.col("ids").alias("ids2"), F.col("codes").alias("codes2"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    pairs = left.join(right, ["copy", "node", "salt"]).where(F.col("task") < F.col("task2"))
    return pairs.select("ids", "codes", "ids2", "codes2").mapInArrow(compare, "a long, b long")


# ---------------------------------------------------------------- components
def components(edges: DataFrame, ws) -> DataFrame:
    """(node, root): each node of the edges (a, b) with the smallest node of its component."""
    edges = ws.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v"), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = ws.write(large.distinct(), "edges")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = ws.write(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    ).distinct()


def _named(texts: DataFrame, rows: DataFrame | None, first: Column, distance: int, shingle: int, similarity: float | None, ws):
    """Rows with their fingerprints; the columns that equal texts share; these, ``first`` of their rows and root.

    texts (row, key, text) is written if there is a similarity; rows (key, code): if given, of a distance."""
    if similarity is None:
        rows, of = ws.write(rows, "fingerprints"), ["code"]
        codes = ws.write(rows.groupBy("code").agg(first.alias("first")).withColumn("id", F.monotonically_increasing_id()), "codes")
        count = codes.count()
        roots = components(links(codes, Copies(blocks_for(count, distance), distance), count, ws), ws)
    else:
        from veiltab.llm import similar

        of = ["code", "total"]
        with narrow_batches(texts.sparkSession):
            rows = ws.write(similar.fingerprints(texts, shingle), "fingerprints")
            codes = rows.groupBy(of).agg(first.alias("first"), F.min("row").alias("row"))
            codes = ws.write(codes.withColumn("id", F.monotonically_increasing_id()), "codes")
            roots = similar.unit_roots(codes, texts, similarity, shingle, codes.count(), ws)
    named = codes.join(roots, F.col("id") == F.col("node"), "left").select(*of, "first", F.coalesce("root", "id").alias("root"))
    # written, so that joins read plain shuffles and a large component can be split
    return rows, of, ws.write(named, "named")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, similarity: float | None = None
) -> DataFrame:
    """(key, fingerprint, component_id) of every row; component_id is the smallest key reachable over
    fingerprints that differ in at most ``distance`` bits, or, if given, over shingle sets of a ``similarity``."""
    ws = workspace(docs.sparkSession, "simhash")
    texts, rows = plain(docs, key=key, text=text), None
    if similarity is None:
        rows = fingerprints(docs, key, text, shingle)
    else:
        texts = ws.write(texts.withColumn("row", F.monotonically_increasing_id()), "texts")
    rows, of, named = _named(texts, rows, F.min("key"), distance, shingle, similarity, ws)
    least = ws.write(named.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    placed = ws.write(named.join(least, "root").select(*of, "component_id"), "placed")
    return rows.join(placed, of, "left").select(F.col("key").alias(key), F.lower(F.hex("code")).alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 4, shingle: int = 4, similarity: float | None = None
) -> DataFrame:
    """One row of each component, all columns: the one with the smallest key, NULL last, and the smallest row id.

    Rows are told apart by an id that is written with them, so rows that share a key, or have none, are
    documents of their own.
    """
    ws = workspace(docs.sparkSession, "simhash")
    name = "_row"
    while name in docs.columns:
        name += "_"
    docs = ws.write(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    texts, rows = plain(docs, row=name, key=key, text=text), None
    if similarity is None:
        rows = fingerprints(texts, "row", "text", shingle).withColumnRenamed("key", "row").join(texts.select("row", "key"), "row")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    _, _, named = _named(texts, rows, first, distance, shingle, similarity, ws)
    kept = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(name))
    return docs.join(kept, name, "left_semi").drop(name)
