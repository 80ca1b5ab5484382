"""Operators 1 and 9 against plain versions."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veiltab.llm import importance, quality_rules
from veiltab.llm.queries import ORACLES, QUERIES, quality_target, toxic_rows
from veiltab.llm.text import column_bytes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def features(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {p for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] >= 2 for p in range(i, i + 5)}
    shouted = sum(len(re.findall("[A-Z]", x)) >= 2 and not re.search("[a-z]", x) for x in w)
    f = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
    failed = f[0] < 10 or 100 * f[4] > 20 * f[0]
    bad = f[1] < 2 * f[0] or f[1] > 20 * f[0] or 10 * f[2] > 3 * f[0] or 10 * f[3] > 5 * len(lines) or 10 * shouted > 4 * f[0]
    return (*f, failed, not (failed or bad))


ROWS = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "a b c d e " * 4), (5, "one line here\n" * 3 + "\n\nother\n"), (6, "ÖZU!! AND THE ME " * 3),
    (7, "x " * 90000), (8, " ".join(f"w{k}" for k in range(500))), (8, " ".join(f"w{k}" for k in range(500))), (None, "é 漢字 😀 # * $ % & | < >"),
    (9, "\r\nA\r\nA\r\n" + " ".join(f"k{k}" for k in range(30))), (10, "loooooooooooooooooooooooooooong" * 3 + " z" * 2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1.5) for r in ROWS], "doc_id long, text string, kept string, n_words double")


def test_assessments_of_odd_rows(odd):
    got = sorted([tuple(r) for r in quality_rules.assess(odd).collect()], key=str)
    assert got == sorted([(k, *features(t)) for k, t in ROWS], key=str)


def test_filter_equals_verdicts_in_any_order(odd, monkeypatch):
    kept = quality_rules.keep_good(odd)
    want = sorted(k or -1 for k, t in ROWS if features(t)[-1])
    assert kept.columns == odd.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == want
    monkeypatch.setattr(quality_rules, "ordered", lambda docs, rules, text: list(rules)[::-1])
    assert sorted(r["doc_id"] or -1 for r in quality_rules.keep_good(odd).collect()) == want


def test_cascade_runs_rules_on_survivors_only():
    seen = []

    def rule(name, bad):
        return quality_rules.Rule(name, lambda t: seen.append((name, len(t))) or np.array([bytes(t.data[a:b]) == bad for a, b in zip(t.bounds, t.bounds[1:])]))

    texts = quality_rules.Texts(*column_bytes(pa.array(["a", "b", "c", "a"])))
    assert quality_rules.passes(texts, [rule("one", b"a"), rule("two", b"b")]).tolist() == [2]
    assert seen == [("one", 4), ("two", 2)]


def test_order_is_by_rejections_per_cost(monkeypatch):
    monkeypatch.setattr(quality_rules, "measure", lambda *a: [("cheap", 1.0, 0.1), ("strong", 2.0, 0.9), ("idle", 0.1, 0.0)])
    rules = [quality_rules.Rule(n, None) for n in ("idle", "cheap", "strong", "unmeasured")]
    assert [r.name for r in quality_rules.ordered(None, rules)][:2] == ["strong", "cheap"]


def test_rules_query_equals_sql(spark, sf):
    from tools.check_oracles import compare, connect

    name = "op9_quality_rules"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])[0] is None


def test_empty_tables(odd):
    assert quality_rules.assess(odd.limit(0)).count() == quality_rules.keep_good(odd.limit(0)).count() == 0
    assert importance.keep_sampled(odd.limit(0), odd.select("doc_id")).count() == 0
    assert importance.keep_sampled(odd, odd.limit(0).select("doc_id")).count() == len(ROWS)  # no target: nothing to tell apart


def grams(text):
    w = [x.encode() for x in WORD.findall(text or "")]
    return [*w, *zip(w, w[1:])]


def test_buckets_are_words_and_pairs():
    texts = ["a b", "", "c", "a b a b"]
    bucket, at = importance.buckets_of(*column_bytes(pa.array(texts)))
    rows = [sorted(bucket[x:y].tolist()) for x, y in zip(at, at[1:])]
    assert [len(r) for r in rows] == [len(grams(t)) for t in texts]
    assert set(rows[0]) <= set(rows[3]) and not rows[1]


def test_weights_equal_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    sample = importance.target_sample(quality_target(spark, sf), "doc_id")
    fitted = {r["key"]: r["fit"] for r in sample.collect()}
    weights = importance.fit(docs, sample, 7)
    rows = docs.collect()
    bucket, at = importance.buckets_of(*column_bytes(pa.array([r["text"] for r in rows])))
    own = [bucket[a:b] for a, b in zip(at, at[1:])]
    raw = np.bincount(bucket, minlength=1 << importance.BITS)
    target = np.bincount(np.concatenate([x for x, r in zip(own, rows) if fitted.get(r["key"])]), minlength=1 << importance.BITS)
    expected = target.sum() * (raw + 1) / (raw.sum() + len(raw))
    want = np.round(1e6 * np.log((target + importance.PRIOR) / (expected + importance.PRIOR))).astype(np.int64)
    assert (weights.log_ratio == want).all()
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample(docs.withColumnRenamed("key", "doc_id"), quality_target(spark, sf))[0].collect()}
    assert all(abs(got[r["key"]] - want[x].sum() / 1e6) < 1e-9 for x, r in zip(own, rows))


@pytest.mark.parametrize("k", [0, 1, 57, 199, 200, 10**6])
def test_sample_of_k(spark, sf, k):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = importance.resample(docs, quality_target(spark, sf), k=k)[0].collect()
    keys = sorted((r["key_value"] for r in got), reverse=True)
    assert sum(r["selected"] for r in got) == min(k, len(got))
    assert all(r["selected"] == (r["key_value"] >= keys[min(k, len(keys)) - 1]) for r in got) if k else True


def test_kth_key_with_ties(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW_KEYS", 3)
    monkeypatch.setattr(importance, "PIECES", 4)
    values = [1.0] * 50 + [2.0, 2.0, 5.0, -3.0, 1e9] + [k / 7 for k in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 2, 3, 40, 100, 355):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]


def test_noise_follows_gumbel_and_is_fixed():
    data, bounds = column_bytes(pa.array([f"text {k}" for k in range(20000)]))
    g = importance.gumbel(pa.array(range(20000)), data, bounds, 3)
    assert abs(g.mean() - 0.5772) < 0.05 and abs(g.var() - np.pi**2 / 6) < 0.1
    assert (g == importance.gumbel(pa.array(range(20000)), data, bounds, 3)).all()


def test_good_documents_stay(spark):
    """Held-out accuracy on the larger table: clean documents stay, most bad ones go."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs, avoid = spark.read.parquet(f"{sf}/documents.parquet"), toxic_rows(spark, sf)
    got = importance.resample(docs, quality_target(spark, sf), avoid=avoid)[0].join(labels, "doc_id")
    learnt = importance.target_sample(avoid, "doc_id").where("fit").select(F.col("key").alias("doc_id"))
    held = got.where("quality = 1 and toxic = 1").join(learnt, "doc_id", "left_anti")
    assert held.agg(F.avg(F.col("selected").cast("int"))).first()[0] <= 0.3
    share = {(r["quality"], r["toxic"]): r["s"] for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("selected").cast("int")).alias("s")).collect()}
    assert share[(1, 0)] > 0.99 and share[(0, 0)] < 0.1


def test_other_columns_survive(odd):
    kept = importance.keep_sampled(odd, odd.where("doc_id = 8").select("doc_id"))
    assert kept.columns == odd.columns
    assert kept.where("doc_id = 8").count() in (0, 2)  # repeated rows share their fate


def test_words_of_rows_to_avoid_against_plain_counts(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "Bad", "worse"] if k % 5 == 0 else ["a", "b", "c", "d"], 6)) for k in range(200)]
    texts[:4] = ["", None, "bad " * 20_000, "a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string")
    avoid = spark.createDataFrame([(k, k % 10 == 0) for k in range(0, 200, 5)], "key long, fit boolean")
    clean = spark.createDataFrame([(k, k % 2 == 0) for k in range(1, 200, 5)], "key long, fit boolean")
    got = importance.fit_avoided(docs, avoid, clean, 0.1)
    learn, held = [k for k in range(0, 200, 10)], [k for k in range(1, 200, 5)]
    sets = [{*(t or "").split()} for t in texts]

    def ratio(w):
        own = sum(w in sets[k] for k in learn)
        return max(0.0, float(np.log((own + 1) / (len(learn) / 200 * sum(w in s for s in sets) + 1)))) if own else 0.0

    want = [sum(sorted((ratio(w) for w in s), reverse=True)[:3]) for s in sets]
    scores = got.scores(*column_bytes(pa.array(texts, pa.string())))
    assert np.allclose(scores, want, atol=1e-5)
    assert np.isclose(got.cut, np.quantile([want[k] for k in held], 0.9, method="higher"), atol=1e-5)
    none = importance.fit_avoided(docs, avoid.limit(0), clean, 0.1)
    assert none.cut == float("inf") and not none.scores(*column_bytes(pa.array(texts, pa.string()))).any()


def test_all_target_rows_are_used_and_large_samples_shuffled(spark, monkeypatch):
    many = spark.range(20_100).select(F.col("id").alias("doc_id"))
    assert importance.target_sample(many, "doc_id").agg(F.count("key"), F.count_if("fit")).first()[0] == 20_100
    docs = spark.createDataFrame([(i if i % 9 else None, f"a b{i % 7} c{i % 31}") for i in range(400)], "doc_id long, text string")
    target, avoid = docs.where("doc_id % 2 = 0").select("doc_id"), docs.where("doc_id % 7 = 3").select("doc_id")

    def result():
        out, weights, least = importance.resample(docs, target, avoid=avoid, miss=0.1)
        return sorted(map(tuple, out.collect()), key=str), weights.log_ratio.tolist(), least

    sample = importance.target_sample(target, "doc_id")
    small = result()
    held = [r["key_value"] for r in importance.resample(docs, target)[0].join(sample.where("not fit"), F.col("doc_id") == F.col("key")).collect()]
    assert small[2] == np.quantile(held, 0.1, method="lower")
    monkeypatch.setattr("veiltab.session.BROADCAST_BYTES", 0)
    assert result() == small


def test_counts_travel_as_slices():
    """A task hands on a row per slice, not one per bucket; their sums are those of the buckets."""
    rng = np.random.default_rng(3)
    size = (1 << importance.WORD_BITS) + importance.SLICE
    tasks = [rng.integers(0, 3, (2, size)) * rng.choice([0, 1, 1 << 40], size) for _ in range(3)]
    tasks[0][:, :-1], tasks[1][:, : 5 * importance.SLICE] = 0, 0
    batches = [importance._sliced(t) for t in tasks]
    assert [b.num_rows for b in batches] == [1, 252, 257]
    got = np.zeros((2, size), np.int64)
    for b in importance._summed(iter(batches)):
        got[:, b.column(0).to_numpy()] = b.column(1).to_numpy(), b.column(2).to_numpy()
    raw, own = sum(tasks)
    assert (got[0] == raw).all() and (got[1] == np.where(raw > 0, own, 0)).all()
    assert not [*importance._summed(iter([importance._sliced(np.zeros((2, size), np.int64))]))]
