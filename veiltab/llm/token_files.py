"""Token ids as flat files of unsigned integers with 64-bit document offsets.

A folder holds, for each part of ascending keys, ``<name>.ids`` (the ids of its documents, one after the
other, little-endian, 16 bits wide if the vocabulary allows and 32 bits else), ``<name>.offsets`` (64-bit
places of the documents in the part, one more than documents) and ``<name>.keys`` (64-bit keys), and one
table ``manifest``. A part's base, the ids of all parts before it, is a prefix sum over the manifest.
Files get names of their own per attempt; those of the attempt that succeeded are in the manifest, so a
task that runs again does no harm.

Defined cases: NULL and empty texts have only the end id; NULL keys come first, as key -2^63; rows with
equal keys are all written, in the order of their ids; an empty table gives a manifest without parts.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veiltab.llm.fragments import json_encoder
from veiltab.llm.shared import plain, uri_filesystem
from veiltab.llm.text import column_bytes

LOWEST = -(1 << 63)
MANIFEST = "part int, name string, width int, documents long, ids long"


def _key_bounds(docs: DataFrame, key: str, parts: int) -> np.ndarray:
    """Keys that split the table into parts of about equal rows."""
    steps = [k / parts for k in range(1, parts)]
    found = plain(docs, key=key).agg(F.percentile_approx("key", steps, 10_000).alias("b")).first()["b"] if steps else None
    return np.unique(np.array(found or [], np.int64))


def write_tokens(
    docs: DataFrame, path: str, end_id: int, folder: str, key: str = "doc_id", text: str = "text", parts: int | None = None
) -> None:
    """Encode every text, append ``end_id`` and write the files in ascending order of the key."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _key_bounds(docs, key, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = json_encoder(path)
        for batch in batches:
            keys = pc.fill_null(batch.column(0), LOWEST)
            part = np.searchsorted(bounds, keys.to_numpy(), "right").astype(np.int32)
            for first, ids, at in enc.rows(*column_bytes(batch.column(1))):
                rows = len(at) - 1
                ids = np.insert(ids, at[1:], end_id)
                at = (at + np.arange(rows + 1)) * ids.itemsize
                raw = pa.BinaryArray.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(part[first : first + rows]), keys.slice(first, rows), raw], ["part", "key", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = json_encoder(path).dtype.itemsize
        fs, root = uri_filesystem(folder)
        out: _Part | None = None
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if out is None or out.part != part[a]:
                    if out is not None:
                        yield out.close()
                    out = _Part(fs, root, int(part[a]), width)
                out.add(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a))
        if out is not None:
            yield out.close()

    fs, root = uri_filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = plain(docs, key=key, text=text).mapInArrow(encode, "part int, key long, ids binary")
    dealt = rows.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "key", "ids")
    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


class _Part:
    """The three files of one part while they are written."""

    def __init__(self, fs, root: str, part: int, width: int):
        self.part, self.width = part, width
        self.name = f"part-{part:06d}-{uuid.uuid4().hex}"
        self.files = [fs.open_output_stream(f"{root}/{self.name}.{k}") for k in ("ids", "offsets", "keys")]
        self.documents = self.ids = 0
        self.files[1].write(np.zeros(1, "<i8").tobytes())

    def add(self, keys: pa.Array, ids: pa.Array) -> None:
        places = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1].astype("<i8")
        self.files[0].write(ids.buffers()[2][places[0] : places[-1]])
        self.files[1].write((self.ids + (places[1:] - places[0]) // self.width).tobytes())
        self.files[2].write(keys.to_numpy().astype("<i8").tobytes())
        self.documents += len(ids)
        self.ids += int(places[-1] - places[0]) // self.width

    def close(self) -> pa.RecordBatch:
        for f in self.files:
            f.close()
        row = {"part": self.part, "name": self.name, "width": self.width, "documents": self.documents, "ids": self.ids}
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], list(row))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per part, with its base: the ids of all parts before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long"))


def _mapped(fs, path: str, kind: str) -> np.ndarray:
    """A file as an array: mapped into memory where the file system is local, read else."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r") if fs.get_file_info(path).size else np.zeros(0, kind)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, ids): the documents of the files, ids as an array if wanted.

    start counts the ids of all documents before; the checksum is over the ids as 32-bit integers."""
    columns = ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = uri_filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                flat = _mapped(fs, f"{root}/{row['name']}.ids", f"<u{row['width']}")
                at = _mapped(fs, f"{root}/{row['name']}.offsets", "<i8")
                keys = _mapped(fs, f"{root}/{row['name']}.keys", "<i8")
                for a in range(0, len(keys), 2000):
                    own = at[a : min(a + 2000, len(keys)) + 1]
                    raw = flat[own[0] : own[-1]].astype("<u4")
                    local = (own - own[0]).tolist()
                    sums = [zlib.crc32(raw[x:y]) for x, y in zip(local, local[1:])]
                    k = pa.array(keys[a : a + len(sums)], mask=keys[a : a + len(sums)] == LOWEST)
                    cols = [k, pa.array(own[:-1] + row["base"]), pa.array(np.diff(own)), pa.array(sums, pa.int64())]
                    if ids:
                        cols.append(pa.ListArray.from_arrays(pa.array(local, pa.int32()), pa.array(raw.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(cols, columns)

    files = manifest(spark, folder)
    tasks = max(1, spark.read.parquet(f"{folder}/manifest").count())
    schema = "key long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")
    return files.repartitionByRange(tasks, "part").mapInArrow(read, schema)
