"""Operator 6 against a dictionary of counts, and against the uses of a language model."""

import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veiltab.llm import suffix_tree
from veiltab.llm.queries import QUERIES
from veiltab.llm.shared import workspace

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall((text or "").encode().lower()), None]


def test_base_and_counts(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    c = Counter(t for k, text in docs if not held[k] for t in tokens(text))
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in QUERIES["op6_suffix_tree_scores"](spark, sf).collect()}
    assert len(got) == len(docs)
    for k, text in docs:
        own, r = tokens(text), got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(own), sum(t in c for t in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


@pytest.fixture(scope="module")
def cyclic(spark):
    """x y always alternate, z follows a b only: contexts tell much."""
    texts = ["x y " * 20 + "a b z q"] * 30 + ["a c w q x y"] * 30 + ["y x"] * 5 + ["z w"] * 5
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "key long, text string")


class Dictionary:
    """The tree by dictionaries of token tuples, built and walked token by token."""

    def __init__(self, texts, order, least, evidence):
        rows = [tokens(t) for t in texts]
        self.c = Counter(t for r in rows for t in r)
        once, twice = (sum(n == k for n in self.c.values()) for k in (1, 2))
        self.total, self.d = sum(self.c.values()), once / (once + 2 * twice) if once and twice else 0.5
        self.listed, self.rest = {}, {}
        candidates = {("<",): len(rows)} | {(t,): n for t, n in self.c.items() if n >= least and t is not None}
        for k in range(1, order + 1):
            pairs = Counter((ctx, r[i]) for r in rows for i in range(len(r)) for ctx in [self.context(r, i, k)] if ctx in candidates)
            new = {}
            for (ctx, t), n in pairs.items():
                p, q = (n - self.d) / candidates[ctx], self.p(ctx[1:], t)
                if n >= least and n * math.log(p / q) >= evidence:
                    new.setdefault(ctx, {})[t] = (p, q, n)
            for ctx, own in new.items():
                self.rest[ctx] = (1 - sum(p for p, _, _ in own.values())) / (1 - sum(q for _, q, _ in own.values()))
                self.listed[ctx] = {t: p for t, (p, _, _) in own.items()}
            candidates = {(*ctx, t): n for ctx, own in new.items() for t, (_, _, n) in own.items() if t is not None and (k == 1 or (*ctx, t)[1:] in candidates)}

    @staticmethod
    def context(row, i, k):
        return tuple(["<", *row][i + 1 - k : i + 1]) if i + 1 >= k else None

    def p(self, ctx, t):
        if not ctx:
            return (self.c[t] - self.d) / self.total if t in self.c else self.d * len(self.c) / self.total
        if t in self.listed.get(ctx, ()):
            return self.listed[ctx][t]
        return self.rest.get(ctx, 1.0) * self.p(ctx[1:], t)

    def score(self, text, order):
        row = tokens(text)
        return sum(math.log10(self.p(self.context(row, i, min(order, i + 1)), t)) for i, t in enumerate(row))


@pytest.mark.parametrize("held_keys", [1 << 21, 300, 0])  # all keys broadcast, some, none
def test_scores_equal_a_dictionary_tree(spark, sf, held_keys):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    extra = ["again and again the same few words " * 3, "the same few words again", "a b z q " * 9, "a b z w"]
    docs = docs[:200] + [(10**6 + k, t) for k, t in enumerate(extra * 2)]
    held = {k: k % 7 == 2 for k, _ in docs}
    set_up = {"order": 3, "least": 2, "evidence": 4.0}
    plain = Dictionary([t for k, t in docs if not held[k]], **set_up)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in suffix_tree.score(df, F.col("key") % 7 != 2, parameters=suffix_tree.Suffixes(held=held_keys, share=1 / (held_keys + 1), **set_up)).collect()}
    assert max(len(ctx) for ctx in plain.rest) == 3
    for k, text in docs:
        assert math.isclose(got[k], plain.score(text, 3), rel_tol=1e-9)


def test_probabilities_sum_to_one(cyclic):
    tree = Dictionary([r["text"] for r in cyclic.collect()], 3, 2, 4.0)
    for ctx in tree.rest:
        assert math.isclose(sum(tree.p(ctx, t) for t in tree.c) + tree.p(ctx, b"never seen"), 1, rel_tol=1e-9)


def test_the_tree_grows_with_the_corpus(spark):
    """Ten times the rows teach it several times the states; rules by share of the corpus would not."""
    sizes = []
    for folder in ("sf0.001", "sf0.01"):
        texts = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("text")
        ws = workspace(spark, "t")
        suffix_tree.Suffixes().fit(texts, ws)
        tree = spark.read.parquet(f"{ws.path}/tree-0")
        sizes.append([tree.where(f"order = {k}").count() for k in (1, 2)])
    print(sizes)
    assert all(large > 3 * small > 0 for small, large in zip(*sizes))


def test_contexts_help_and_order_zero_does_not_see_them(spark, cyclic):
    docs = spark.createDataFrame([(1, "x y x y x y"), (2, "y y x x y x"), (3, "a b z q"), (4, "a b w q")], "key long, text string").union(
        cyclic.select(F.col("key") + 100, "text")
    )
    train = F.col("key") >= 100
    small = {"least": 2}
    got = {r["key"]: r for r in suffix_tree.score(docs, train, "key", parameters=suffix_tree.Suffixes(**small)).collect()}
    assert got[1]["score"] > got[2]["score"] + 1 and got[3]["score"] > got[4]["score"] + 0.5
    flat = {r["key"]: r for r in suffix_tree.score(docs, train, "key", parameters=suffix_tree.Suffixes(order=0, **small)).collect()}
    assert math.isclose(flat[1]["score"], flat[2]["score"], rel_tol=1e-9)


def test_rare_keys_are_joined(spark, cyclic):
    """That every token and state is joined changes no score."""
    one, two = (suffix_tree.score(cyclic, F.lit(True), "key", parameters=suffix_tree.Suffixes(held=x, share=1 / (x + 0.5))).orderBy("key").collect() for x in (1 << 21, 0))
    for a, b in zip(one, two, strict=True):
        assert (a["n_known"], a["n_tokens"]) == (b["n_known"], b["n_tokens"])
        assert math.isclose(a["score"], b["score"], rel_tol=1e-9) and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9)


def test_odd_rows(spark):
    rows = [(1, None, 0.1), (1, "", 0.1), (1, "", 0.1), (None, "a A a", 0.1), (7, "w " * 50000, 0.1), (8, "é 　 x", 0.1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = suffix_tree.score(df, F.lit(True)).collect()
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == sorted(
        (k or -1, n, n, 50012) for k, n in [(1, 1), (1, 1), (1, 1), (None, 4), (7, 50001), (8, 4)]
    )
    nothing = suffix_tree.score(df, F.lit(False)).collect()
    assert all(r["score"] == r["base_score"] == r["n_known"] == r["train_tokens"] == 0 for r in nothing)
    assert suffix_tree.score(df.limit(0), F.lit(True)).count() == 0


def test_few_seldom_pairs_are_shuffled(spark, monkeypatch):
    """Pairs after two tokens that are seen once travel packed: only those seen often are rows, each counted exactly."""
    texts = [f"a b s{k} ." for k in range(400)] + ["a b c d"] * 30 + [f"u{k} u{k} u{k}" for k in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    blocks, often = [], suffix_tree._Packed.often

    def counted(self, frame, least):
        blocks.append(often(self, frame, least).cache())
        return blocks[-1]

    monkeypatch.setattr(suffix_tree._Packed, "often", counted)
    ws = workspace(spark, "t")
    suffix_tree.Suffixes(evidence=1.0).fit(df, ws)
    assert len(blocks) == 2 and 0 < blocks[1].count() < 10
    pairs = spark.read.parquet(f"{ws.path}/pairs2-0").collect()
    assert {30, 430} <= {r["n"] for r in pairs} and all(r["n"] >= 4 for r in pairs)  # a text's begin, a, then b: 430
