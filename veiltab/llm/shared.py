"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.session import Workspace, shared_dir


_open: list[Workspace] = []


def workspace(spark: SparkSession, name: str) -> Workspace:
    ws = Workspace(spark, f"llm-{name}")
    _open.append(ws)
    return ws


@contextmanager
def released() -> Iterator[None]:
    """Delete the tables of all workspaces opened inside, at the end: what is read from them must be written by then."""
    before = len(_open)
    try:
        yield
    finally:
        for ws in _open[before:]:
            ws.close()
        del _open[before:]


@contextmanager
def narrow_batches(spark: SparkSession, size: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most ``size`` bytes (one longer row is a batch) for what runs inside: by default
    10,000 rows make one, which for rows that carry whole sets is tens of megabytes on both sides."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for files, below the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns under names of our own, so that other columns cannot clash."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def lower_az(c: Column) -> Column:
    """A-Z to a-z, all other characters unchanged."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def uri_filesystem(uri: str):
    """pyarrow's file system and path for a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
