"""A training corpus from raw documents in five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veiltab.llm import bpe, decontaminate, importance, quality_rules, simhash
from veiltab.llm.queries import BYTE_BPE, quality_target, toxic_rows
from veiltab.llm.shared import released, table, workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample stay, but for those like the toxic ones. Each rule loses a few
    in a thousand of the good ones held out."""
    return importance.keep_sampled(docs, quality_target(spark, sf_dir), avoid=toxic_rows(spark, sf_dir))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects stay."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest doc_id: shingles of five words, 0.8 similar."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids: doc_id, token_ids."""
    return bpe.encode(docs, public_tokenizers.path(BYTE_BPE)).withColumnRenamed("ids", "token_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and reread as the next stage's documents."""
    ws = workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released():  # what the stage wrote on its way goes once its result is written
            docs = ws.write(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has neither the drawn sample nor the fingerprints; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None
