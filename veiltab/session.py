"""Session helpers: a local session for tests and the place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_SALTS = 1 << 20
BROADCAST_BYTES = 64 << 20  # a side above this is joined by shuffle instead


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veiltab")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder: on a cluster a folder of the driver's
    machine cannot be read by the executors, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    named = tempfile.mkdtemp(prefix="veiltab-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


class Workspace:
    """Written tables of one run, in the shared folder.

    A loop that writes ``name`` again and again alternates between two slots, so that a round can
    read the last table while it writes the next one and storage stays at two copies.
    """

    def __init__(self, spark: SparkSession, run: str = "run"):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{run}-{uuid.uuid4().hex}"
        self._turn: dict[str, int] = {}

    def write(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        turn = self._turn.get(name, 0)
        self._turn[name] = turn + 1
        path = f"{self.path}/{name}-{turn % 2}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str, last: bool = True) -> None:
        """Delete what was written as ``name``; without ``last`` only the table before the last one."""
        turn = self._turn.get(name, 0)
        for slot in {turn % 2, *([(turn + 1) % 2] if last else [])}:
            self._delete(f"{self.path}/{name}-{slot}")

    def close(self) -> None:
        """Delete the run's tables; frames over them can't be read any more."""
        self._delete(self.path)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of an action inside go when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_side(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast when ``rows`` (a known bound) fits; leave the choice to AQE otherwise."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lookup(
    df: DataFrame, table: DataFrame, on: list[str], rows: int, how: str = "left", salts: int = 16
) -> DataFrame:
    """Join a keyed table whose size bound is ``rows``.

    Small tables are broadcast. Larger ones are repeated ``salts`` times and joined on key + salt,
    so that a key holding a third of ``df`` spreads over ``salts`` tasks. NULL keys find nothing; they
    get salts of their own, so that any number of them spreads over all tasks.
    """
    if rows * 64 <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), on, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    empty = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    spread = F.pmod(F.xxhash64(*df.columns), F.when(empty, NULL_SALTS).otherwise(salts)).cast("int")
    return df.withColumn("_salt", spread).join(salted, [*on, "_salt"], how).drop("_salt")
