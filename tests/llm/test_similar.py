"""Groups by similarity against the Jaccard similarity of all pairs."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veiltab.llm import similar, simhash


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, similarity=0.8):
    """The label of each text: the smallest index of its group; and the number of pairs."""
    own = [shingles(t) for t in texts]
    empty = [k for k, s in enumerate(own) if not s]
    holders, a, b = {}, empty[:1] * len(empty[1:]), empty[1:]
    for k, s in enumerate(own):
        shared = {}
        for g in s:
            for other in holders.setdefault(g, []):
                shared[other] = shared.get(other, 0) + 1
            holders[g].append(k)
        for other, n in shared.items():
            if n / (len(s) + len(own[other]) - n) >= similarity:
                a.append(other)
                b.append(k)
    return simhash.join_labels(np.arange(len(own)), np.array(a, int), np.array(b, int)).tolist(), len(a)


def groups(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()}
    return [got[k] for k in range(len(texts))]


def template(rng, n, length, changed):
    """Texts that differ from one in a tail of their own: any two share the same number of shingles."""
    base = [f"b{x}" for x in rng.integers(0, 10**6, length - changed)]
    return [" ".join([*base, *(f"t{x}" for x in rng.integers(0, 10**9, changed))]) for _ in range(n)]


def test_pairs_below_the_similarity_stay_apart(spark):
    """Distances of pairs of 0.7 to 0.78 are mostly those of similar ones; the sets tell them apart."""
    rng = np.random.default_rng(1)
    texts = [t for changed in (48, 50, 52, 60, 70) for _ in range(30) for t in template(rng, 2, 400, changed)]
    label, pairs = brute(texts)
    assert pairs == 0 and groups(spark, texts) == label


def test_pairs_of_just_the_similarity_are_found(spark):
    rng = np.random.default_rng(2)
    texts = [t for _ in range(300) for t in template(rng, 2, 400, 44)]  # 352 of 440 shingles
    label, pairs = brute(texts)
    got = groups(spark, texts)
    assert pairs == 300 and sum(a == b for a, b in zip(got, label)) >= 590


def test_dense_group_of_unlike_texts(spark):
    """A pair that a rejected one had hidden is found: copies among many texts that are all near, but unlike."""
    rng = np.random.default_rng(3)
    texts = template(rng, 150, 400, 52)
    texts += [t.rsplit(" ", 1)[0] + f" z{k}" for k, t in enumerate(texts[::3])]
    texts = [texts[k] for k in rng.permutation(len(texts))]
    label, pairs = brute(texts)
    assert pairs == 50 and groups(spark, texts) == label


def test_many_components_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "FEW_EDGES", 3)
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "one", "ONE", *(t for _ in range(8) for t in template(rng, 3, 300, 8)), *template(rng, 30, 300, 40)]
    assert groups(spark, texts) == brute(texts)[0]


@pytest.mark.parametrize("n", [100, 400])
def test_unlike_texts_of_one_dense_group_are_not_paired_out(spark, monkeypatch, n):
    """All pairs are at about 0.77: what is tested follows the number of texts, not of their pairs."""
    made, real = [], similar.tested
    monkeypatch.setattr(similar, "tested", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    texts = template(np.random.default_rng(5), n, 400, 52)
    assert groups(spark, texts) == list(range(n)) and sum(made) <= 12 * n


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.5, 0.8, 0.9]))
def test_rare_shingles_lose_no_pair(seed, t):
    """The rarest shingles of two similar sets, in any common order, have one in common."""
    rng = np.random.default_rng(seed)
    x = {*rng.integers(0, 60, rng.integers(1, 50)).tolist()}
    y = {*x, *rng.integers(0, 60, 5).tolist()} - {*rng.integers(0, 60, 6).tolist()}
    if not y or len(x & y) < t * len(x | y):
        return
    x, y = sorted((sorted(x), sorted(y)), key=len)
    short = x[: len(x) - math.ceil(2 * t / (1 + t) * len(x) - 1e-9) + 1]
    assert {*short} & {*y[: len(y) - math.ceil(t * len(y) - 1e-9) + 1]} and len(x) >= t * len(y) - 1e-9


def test_documents(spark):
    """Whole groups of the larger table: nothing unlike goes, and next to all similar pairs are found."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").collect()
    label, pairs = brute([r["text"] for r in docs])
    keys = [r["doc_id"] for r in docs]
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df, shingle=5, similarity=0.8).collect()}
    want = {k: keys[m] for k, m in zip(keys, label)}
    lost = [k for k in keys if got[k] != want[k]]
    print(f"{pairs} similar pairs, {len(lost)} documents of {len(keys)} in another group than by all pairs")
    assert all(want[got[k]] == want[k] for k in keys)  # never united beyond the groups of all pairs
    assert pairs and len(lost) <= 0.02 * sum(want[k] != k for k in keys)
