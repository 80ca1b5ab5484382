"""Rows of a sample are found by keys that travel with the tasks, not by a table broadcast from the driver."""

import pytest
from pyspark.sql import functions as F

from veiltab.llm import importance


def rows(spark):
    keys = [None, -5, 0, 0, 3, 1 << 62, -(1 << 62), *range(10, 60)]
    return spark.createDataFrame([(k, f"a b{i % 7} c{i}") for i, k in enumerate(keys)], "key long, text string")


@pytest.mark.parametrize("room", [0, 64 << 20])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_known_keys(spark, monkeypatch, room, how):
    monkeypatch.setattr("veiltab.session.BROADCAST_BYTES", room)
    docs = rows(spark)
    for sample in (docs.where("key % 3 = 0").select("key").distinct(), docs.where("key > 1000000").select("key").limit(0)):
        known = importance.Known(sample)
        has, wanted = known.has, {r["key"] for r in sample.collect()}
        got = known.rows(docs, "text", how).toArrow()
        marks = got.column("mark").combine_chunks()
        found = sorted(t for t, m in zip(got.column("text").to_pylist(), has(marks)) if m)
        assert found == sorted(r["text"] for r in docs.collect() if r["key"] in wanted)


def test_no_table_of_keys_is_broadcast(spark, monkeypatch):
    """Before: up to a million keys of the target were broadcast as rows, more than once at a time."""
    docs = rows(spark).withColumnRenamed("key", "doc_id")
    target, avoid = docs.where("doc_id % 2 = 0").select("doc_id"), docs.where("doc_id % 7 = 3").select("doc_id")
    made = []
    monkeypatch.setattr(F, "broadcast", lambda df: made.append(df.columns) or df)
    out, _, _ = importance.resample(docs, target, avoid=avoid, miss=0.1)
    assert out.count() == docs.count() and not made
