"""Token counts through a digest cache.

The cache holds (version, digest, n_tokens): version is the digest of the tokenizer file, of the
library and of the options, digest the SHA-256 of the normalised text. Only digests without a stored
count are encoded, once each, and appended. The normalisation must not change counts; here it reads
NULL as the empty text and nothing more, as the tokenizer normalises by itself.

Each run that finds misses writes a folder of its own below that of the version, so runs never share
an output folder; a reader takes all folders it finds. Two runs that encode the same digest leave equal
rows, of which one is read.

Defined cases: NULL and empty texts have no tokens; repeated texts are encoded once and counted for
each row; an empty table, or one without a miss, writes nothing to the cache; a text of any length is one
row of one task; other columns, also of the names used here, are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veiltab.llm.fragments import json_encoder
from veiltab.llm.shared import plain, workspace
from veiltab.llm.text import column_bytes
from veiltab.session import BROADCAST_BYTES

CACHE = "digest binary, n_tokens long"


def version_of(path: str) -> str:
    """Digest of what decides the counts."""
    with open(path, "rb") as f:
        own = hashlib.sha256(f.read())
    own.update(f"tokenizers {tokenizers.__version__}; nothing added, truncated or padded".encode())
    return own.hexdigest()


def of_version(cache: str, version: str) -> str:
    return f"{cache.rstrip('/')}/version={version}"


def stored(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, each digest once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(of_version(cache, version))
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).option("recursiveFileLookup", "true").parquet(of_version(cache, version))
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row; ``cache`` is a folder that outlives the run."""
    spark = docs.sparkSession
    ws, version = workspace(spark, "tokencounts"), version_of(path)
    normal = F.coalesce(F.col("text"), F.lit(""))
    rows = plain(docs, key=key, text=text).select("key", normal.alias("text"), F.unhex(F.sha2(normal, 256)).alias("digest"))
    own = ws.write(rows.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    misses = ws.write(own.select("digest").distinct().join(stored(spark, cache, version), "digest", "left_anti"), "misses")
    n_misses = misses.count()
    few = n_misses * 64 <= BROADCAST_BYTES
    texts = rows.select("digest", "text").join(F.broadcast(misses) if few else misses, "digest", "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = json_encoder(path)
        for batch in batches:
            counts = enc.counts(*column_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["digest", "n_tokens"])

    counted = texts.dropDuplicates(["digest"]).mapInArrow(encode, "digest binary, n_tokens long")
    if n_misses:
        counted.write.parquet(f"{of_version(cache, version)}/run={uuid.uuid4().hex}")
    # one row per digest, written, so that the join below reads plain shuffles and a hot digest can be split
    known = ws.write(own.select("digest").distinct().join(stored(spark, cache, version), "digest"), "known")
    return own.join(known, "digest").select(F.col("key").alias(key), "n_bytes", "n_tokens")
