"""Operator 3 against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from veiltab.llm import simhash
from veiltab.llm.queries import QUERIES
from veiltab.llm.shared import workspace


def fingerprint(text, n=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(keys, fps, distance=4):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= distance
    label = simhash.join_labels(np.arange(len(fps)), *np.nonzero(near))
    return [min(k for k, m in zip(keys, label) if m == own) for own in label]


def test_query_equals_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps, keys = [fingerprint(r["text"]) for r in docs], [r["doc_id"] for r in docs]
    want = dict(zip(keys, zip((f"{f:016x}" for f in fps), brute(keys, fps))))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_near_dedup"](spark, sf).collect()}
    assert got == want


def near_codes(seed, n):
    """Chance codes, groups of near ones and one dense group that differs in few places."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = [base]
    for c in base[:30]:
        group = np.full(rng.integers(2, 50), c)
        for _ in range(5):
            group = group ^ (np.uint64(1) << rng.integers(0, 64, len(group)).astype(np.uint64))
        out.append(group)
    dense = np.full(1500, base[0])
    for b in rng.choice(64, 13, replace=False):
        dense = dense ^ (rng.integers(0, 2, 1500).astype(np.uint64) << np.uint64(b))
    return np.unique(np.concatenate([*out, dense]))


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_links_lose_nothing(spark, blocks):
    codes = near_codes(blocks, 1500)
    df = spark.createDataFrame([(k, int(c).to_bytes(8, "big")) for k, c in enumerate(codes)], "id long, code binary")
    ws = workspace(spark, "test")
    links = simhash.links(df, simhash.Copies(blocks, 4), len(codes), ws)
    got = {r["node"]: r["root"] for r in simhash.components(links, ws).collect()}
    ids = list(range(len(codes)))
    assert [got.get(c, c) for c in ids] == brute(ids, codes)


def test_similar_texts_are_found(spark):
    """By similarity: copies with a few words changed go together, texts that share half do not."""
    rng = np.random.default_rng(5)
    rows, groups = [], 40
    for g in range(groups):
        text = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        rows.append((10 * g, " ".join(text)))
        for c in range(1, 4):
            near = list(text)
            for at in rng.integers(0, 400, 4):
                near[at] = f"v{rng.integers(0, 10**6)}"
            rows.append((10 * g + c, " ".join(near)))
        rows.append((10 * g + 5, " ".join(text[:270] + [f"u{x}" for x in rng.integers(0, 10**6, 130)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()}
    assert got == {k: k if k % 10 == 5 else k // 10 * 10 for k, _ in rows}


def test_more_blocks_for_more_codes():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**5, 10**9, 10**12)] == [6, 6, 7, 8]


def test_chain_of_links_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(200, 201), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges, workspace(spark, "test")).collect()}
    assert got == {**{k: 0 for k in range(71)}, 200: 200, 201: 200}


def test_odd_rows(spark):
    words = " ".join(f"w{k}" for k in range(300))
    rows = [(5, words, "x", 1), (9, words.upper(), "x", 1), (9, words.upper(), "x", 1), (2, None, "x", 1), (3, " \n\t", "x", 1)]
    rows += [(None, "alone here now", "x", 1), (7, "a b", "x", 1), (8, "w " * 70000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string, fp int")
    got = sorted(((r["doc_id"] or -1), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect())
    assert got == sorted((r[0] or -1, f"{fingerprint(r[1]):016x}", {9: 5, 3: 2}.get(r[0], r[0])) for r in rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 2, 5, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_rows_that_share_a_key_or_have_none_are_documents(spark, similarity):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(12)]
    rows = [(None, t, "x") for t in texts[:4]] + [(7, t, "x") for t in texts[4:8]] + [(k, t, "x") for k, t in enumerate(texts[8:], 8)]
    rows += [(None, texts[5], "copy"), (9, texts[6], "copy"), (3, texts[11], "copy"), (None, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string").repartition(5)
    kept = simhash.one_of_each(df, similarity=similarity)
    want = [(None, t, "x") for t in texts[:4]] + [(7, t, "x") for t in texts[4:8]] + [(k, texts[k], "x") for k in (8, 9, 10)]
    assert kept.columns == df.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [*want, (3, texts[11], "copy")]))
