"""The pipeline's stages, each held against a plain version on its own input."""

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import brute as plain_scan
from tests.llm.test_quality import features
from tests.llm.test_similar import brute
from veiltab.llm import importance
from veiltab.llm.queries import quality_target, toxic_rows
from veiltab.llm.text import column_bytes

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def steps(spark, sf):
    """What goes into each stage and what comes out, as rows by doc_id."""
    from veiltab.session import Workspace

    ws, docs, out = Workspace(spark, "steps"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = ws.write(stage(spark, docs, sf), name)
        out[name] = (docs, {r["doc_id"]: r for r in docs.collect()}, made, {r["doc_id"]: r for r in made.collect()})
        docs = made
    return out


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(steps)
    for name in list(steps)[:-1]:
        before, _, after, _ = steps[name]
        assert after.columns == before.columns
    assert steps["bpe_encoding"][2].columns == ["doc_id", "token_ids"]


def test_classifier_keeps_what_its_weights_say(spark, sf, steps):
    docs, before, _, after = steps["quality_classifier"]
    scored, weights, least = importance.resample(docs, quality_target(spark, sf), avoid=toxic_rows(spark, sf))
    keys = list(before)
    _, value = weights.rows(pa.array(keys, pa.int64()), *column_bytes(pa.array([before[k]["text"] for k in keys])))
    chosen = {r["doc_id"] for r in scored.where("selected").collect()}
    assert set(after) == chosen and chosen <= {k for k, v in zip(keys, value) if v >= least}
    good = {r["doc_id"] for r in quality_target(spark, sf).collect()} & set(before)
    assert len(good & set(after)) >= 0.99 * len(good)


def test_rules_keep_what_no_rule_rejects(steps):
    _, before, _, after = steps["quality_rules"]
    assert set(after) == {k for k, r in before.items() if features(r["text"])[-1]}


def test_one_document_of_each_group_stays(steps):
    _, before, _, after = steps["near_duplicates"]
    keys = sorted(before)
    label, _ = brute([before[k]["text"] for k in keys])
    # drawn copies propose a pair at the limit with probability 0.99, others with more
    want = {keys[k] for k in range(len(keys)) if label[k] == k}
    assert want <= set(after) and len(set(after) - want) <= 0.02 * len(keys)
    texts = [r["text"] for r in after.values()]
    assert len(texts) == len(set(texts))


def test_contaminated_documents_go(spark, sf, steps):
    _, before, _, after = steps["benchmark_decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {k for k, _, n, _ in plain_scan([(k, r["text"]) for k, r in before.items()], items) if n}
    assert hit and set(after) == set(before) - hit


def test_ids_are_those_of_the_library(steps):
    _, before, _, after = steps["bpe_encoding"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(after) == set(before)
    for k, r in before.items():
        assert after[k]["token_ids"] == tok.encode(r["text"] or "", add_special_tokens=False).ids


def test_odd_rows_pass_every_stage(spark, sf):
    """NULLs, empty and repeated rows, clashing names and an empty table go through without harm."""
    words = " ".join(f"word{k}" for k in range(60))
    rows = [(1, words, "x", 1.0), (1, words, "x", 1.0), (2, None, None, None), (3, "", "x", 1.0), (None, words + " more", "x", 1.0), (4, words, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, n_words double")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf).persist()
            if name == "near_duplicates" and docs.count():
                assert [r["doc_id"] for r in docs.collect()] == [1]
    assert STAGES
