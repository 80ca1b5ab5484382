"""Best-fit packing of documents into sequences of a fixed length, by hierarchical residual packing.

1. Every text is encoded and closed with an end id; only documents longer than a sequence are cut, into
   pieces of that length. The pieces are written with their ids. Full pieces are sequences already.
2. Each partition packs its other pieces by best fit, largest first. Bins that are nearly full are emitted.
3. The bins that are left are items themselves: fewer tasks, each with the bins of several, pack them
   again, and so on up a tree. A task never holds more than ``TASK_ITEMS`` items: when so many bins stay
   open that one task cannot hold them, the rounds go on over mixed groups of that size until a round saves
   less than one bin in a thousand. Bins of different tasks are named by their first piece.
4. A piece's sequence and place are found by following its bin up the rounds, with one join a round.

Best fit works on classes of equal size and equal room, so its time follows the number of sizes, not of items.

Defined cases: NULL and empty texts are one end id; very long texts are whole, in as many pieces as they
need; repeated rows and rows that share a key, or have none, are documents of their own; ties go by the
piece's number; an empty table has no pieces; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veiltab.llm.fragments import json_encoder
from veiltab.llm.shared import plain
from veiltab.llm.text import column_bytes
from veiltab.session import Workspace, small_side

LENGTH = 4096
NEARLY = 256  # a bin with less than this part of a sequence free is emitted
MERGED = 8  # tasks of a round whose bins meet in one task of the next
TASK_ITEMS = 1 << 18
SAVED = 1000  # rounds over more than one full task end when they save less than this part of the bins
PIECES = "key long, piece int, start long, length int, width int, ids binary"
PLACED = "item long, bin long, offset int, used int"


def best_fit(size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item, largest items first, each into the bin with the least room that holds it.

    Bins are numbered from 0. A bin that took one item of a size has the least room for the next of that
    size, as long as it holds it, so items of one size are dealt out to whole classes of bins at once.
    """
    order = np.argsort(-size, kind="stable")
    bins, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    count = np.zeros(room + 1, np.int64)  # bins by the room they have
    held: list[list[np.ndarray]] = [[] for _ in range(room + 1)]
    made = 0

    def put(left: int, own: np.ndarray) -> None:
        if left and len(own):
            count[left] += len(own)
            held[left].append(own)

    kinds, first = np.unique(-size[order], return_index=True)
    ends = np.append(first[1:], len(size))
    for s, a, b in zip((-kinds).tolist(), first.tolist(), ends.tolist()):
        while a < b:
            fits = count[s:] > 0
            left = s + int(fits.argmax())
            if count[left]:
                each = left // s
                want = min(int(count[left]), -(-(b - a) // each))
                own = np.concatenate(held[left])
                count[left] -= want
                held[left] = [own[want:]] if want < len(own) else []
                own = own[:want]
            else:
                left, each = room, room // s
                own = np.arange(made, made - (-(b - a) // each))
                made += len(own)
            n = min(b - a, each * len(own))
            items, turn = order[a : a + n], np.arange(n) % each
            bins[items] = np.repeat(own, each)[:n]
            place[items] = room - left + s * turn
            short = n % each  # items of the last bin, if it isn't used up
            put(left - s * each, own[:-1] if short else own)
            if short:
                put(left - s * short, own[-1:])
            a += n
    return bins, place


def pieces(docs: DataFrame, path: str, end_id: int, ws: Workspace, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(item, key, piece, start, length, width, ids): the documents' pieces, ids as unsigned integers of ``width`` bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = json_encoder(path)
        for batch in batches:
            for first, ids, at in enc.rows(*column_bytes(batch.column(1))):
                rows = len(at) - 1
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(rows + 1)
                size = np.diff(at)
                many = -(-size // length)
                row = np.repeat(np.arange(rows), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                start = piece * length
                own = np.minimum(size[row] - start, length)
                bounds = np.append(at[row] + start, at[-1]) * ids.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start),
                        pa.array(own, pa.int32()), pa.array(np.full(len(row), ids.itemsize), pa.int32()), raw.cast(pa.binary()),
                    ],
                    ["key", "piece", "start", "length", "width", "ids"],
                )

    made = plain(docs, key=F.col(f"`{key}`").cast("long"), text=text).mapInArrow(encode, PIECES)
    return ws.write(made.withColumn("item", F.monotonically_increasing_id()), "pieces")


def pack_once(items: DataFrame, length: int) -> DataFrame:
    """(item, bin, offset, used) of items (item, length): every task packs what it has, ``TASK_ITEMS`` at a time."""

    def packed(item: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(item)
        item, size = item[order], size[order]
        bins, place = best_fit(size, length)
        used = np.bincount(bins, size).astype(np.int64)
        name = np.empty(len(used), np.int64)
        name[bins[place == 0]] = item[place == 0]
        cols = [pa.array(item), pa.array(name[bins]), pa.array(place, pa.int32()), pa.array(used[bins], pa.int32())]
        return pa.RecordBatch.from_arrays(cols, ["item", "bin", "offset", "used"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_ITEMS:
                yield packed(*_columns(held))
                held = []
        if sum(b.num_rows for b in held):
            yield packed(*_columns(held))

    return items.select("item", "length").mapInArrow(run, PLACED)


def _columns(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]).astype(np.int64) for k in range(2))


def place(items: DataFrame, ws: Workspace, length: int = LENGTH) -> DataFrame:
    """(item, sequence_id, offset) of items (item, length) that are at most ``length``; read from written tables."""
    open_bins = items.where(F.col("length") < length)
    tasks, rounds = open_bins.rdd.getNumPartitions(), []
    while True:
        done = ws.write(pack_once(open_bins, length), f"round{len(rounds)}")
        of = done.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("offset") == 0, 1)).alias("bins")).first()
        rounds.append((done, of["n"]))
        # a bin stands where its first item stood
        left = done.where((F.col("offset") == 0) & (length - F.col("used") > length // NEARLY))
        left = left.select(F.col("bin").alias("item"), F.col("used").alias("length"))
        count = left.count()
        least = max(1, -(-count // TASK_ITEMS))
        little = (of["n"] - of["bins"]) * SAVED <= of["n"]
        if count < 2 or tasks == 1 or (len(rounds) > 1 and tasks <= least and little):
            break
        tasks = max(least, -(-tasks // MERGED))
        open_bins = left.repartition(tasks, F.xxhash64("item", F.lit(len(rounds))))
    found = rounds[-1][0].select("item", F.col("bin").alias("sequence_id"), "offset")
    for (done, _), (_, n) in zip(rounds[-2::-1], rounds[:0:-1]):
        up = found.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("before"))
        joined = done.join(small_side(up, n), "bin", "left")
        found = joined.select(
            "item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("before", F.lit(0))).alias("offset")
        )
    return found


def pack(
    docs: DataFrame, path: str, end_id: int, ws: Workspace, length: int = LENGTH, key: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The pieces with their ids, and (item, sequence_id, offset) of each."""
    own = pieces(docs, path, end_id, ws, length, key, text)
    found = ws.write(place(own.select("item", "length"), ws, length), "places")
    full = own.where(F.col("length") == length).select("item", F.col("item").alias("sequence_id"), F.lit(0).alias("offset"))
    return own, found.select("item", "sequence_id", F.col("offset").cast("int").alias("offset")).union(full)


def sequences(own: DataFrame, places: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves. One has at most as many pieces as ids."""
    rows = own.join(places, "item").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    total = F.aggregate("p", F.lit(0), lambda n, p: n + p["length"])
    ids = F.aggregate("p", F.lit(b""), lambda raw, p: F.concat(raw, p["ids"]))
    return rows.select("sequence_id", total.alias("length"), ids.alias("ids"))


def checksums(own: DataFrame) -> DataFrame:
    """(item, key, piece, start, length, ids_crc32): the checksum is over the ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column(5).to_pylist()
            sums = [zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4")) for w, x in zip(kinds, batch.column(6))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sums, pa.int64())], ["item", "key", "piece", "start", "length", "ids_crc32"])

    columns = ["item", "key", "piece", "start", "length", "width", "ids"]
    return own.select(*columns).mapInArrow(run, "item long, key long, piece int, start long, length int, ids_crc32 long")
