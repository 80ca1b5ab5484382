"""Operator 13: whole documents, gapless sequences, and how many of them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veiltab.llm import packing
from veiltab.llm.queries import QUERIES
from veiltab.llm.shared import workspace

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_best_fit(sizes, room):
    left, out = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[k]]
        if fits:
            b = min(fits)[1]
        else:
            left.append(room)
            b = len(left) - 1
        out[k] = (b, room - left[b])
        left[b] -= sizes[k]
    return len(left), sorted(left)


@settings(max_examples=200, deadline=None)
@given(sizes=st.lists(st.integers(1, 40), max_size=60))
def test_classes_fill_as_best_fit_does(sizes):
    bins, place = packing.best_fit(np.array(sizes, np.int64), 40)
    count, left = plain_best_fit(sizes, 40)
    used = np.bincount(bins, sizes, minlength=count) if sizes else np.zeros(0)
    assert len(used) == count and sorted((40 - used).tolist()) == left
    for b in range(count):
        own = sorted((place[k], sizes[k]) for k in np.flatnonzero(bins == b))
        assert [p for p, _ in own] == [0, *np.cumsum([s for _, s in own])[:-1]]


def gapless(rows, length):
    """rows (sequence, offset, length): every sequence is filled from 0 on without gaps; the number of sequences."""
    of = defaultdict(list)
    for s, o, n in rows:
        of[s].append((o, n))
    for own in of.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= length
    return len(of)


def test_query_against_the_library(spark, sf):
    tok = Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            own = ids[p : p + 4096]
            want[r["doc_id"], p // 4096] = (p, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    got = QUERIES["op13_best_fit_packing"](spark, sf).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    made = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], 4096)
    assert made <= 1.01 * sum(n for _, n, _ in want.values()) / 4096 + 1


def test_number_of_sequences_on_the_larger_table(spark):
    got = QUERIES["op13_best_fit_packing"](spark, "/root/testdata/sf0.1").select("sequence_id", "offset", "length").collect()
    made = gapless([tuple(r) for r in got], 4096)
    assert made <= 1.002 * sum(r["length"] for r in got) / 4096 + 1


def test_edge_rows_and_the_sequences_themselves(spark):
    random.seed(1)
    long = " ".join(random.choice(["alpha", "beta", "x", "unfathomable"]) for _ in range(30_000))
    texts = ["", None, " ", "same", "same", long, "a" * 3000, *(" ".join(["w"] * n) for n in range(1, 60))]
    docs = spark.createDataFrame([(None if k == 2 else k % 50, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, item int, ids string")
    ws = workspace(spark, "test")
    own, places = packing.pack(docs, PATH, 1, ws, length=64)
    tok = Tokenizer.from_file(PATH)
    want = sorted([*tok.encode(t or "", add_special_tokens=False).ids, 1] for t in texts)
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in packing.sequences(own, places).collect()}
    docs_back, held = [], {}
    for r in own.join(places, "item").orderBy("item").collect():
        ids = made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert ids == np.frombuffer(r["ids"], "<u2").tolist()
        if r["piece"] == 0:
            docs_back.append([])
        docs_back[-1] += ids
    assert sorted(docs_back) == want
    assert gapless([(r["sequence_id"], r["offset"], r["length"]) for r in own.join(places, "item").collect()], 64) == len(made)
    empty, none = packing.pack(docs.limit(0), PATH, 1, workspace(spark, "test"))
    assert empty.count() == 0 and none.count() == 0


@pytest.mark.parametrize("kind", ["mixed", "large", "hot"])
def test_rounds_up_the_tree(spark, monkeypatch, kind):
    """Small tasks: many rounds, more bins than one task may hold, and still few sequences."""
    monkeypatch.setattr(packing, "TASK_ITEMS", 300)
    rng = random.Random(7)
    sizes = {
        "mixed": [rng.randint(1, 999) for _ in range(4000)],
        "large": [rng.randint(501, 999) for _ in range(2000)],  # no two fit together
        "hot": [600] * 1000 + [rng.randint(1, 400) for _ in range(2000)],
    }[kind]
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length int").repartition(24)
    ws = workspace(spark, "test")
    got = packing.place(ws.write(items, "items"), ws, 1000).join(items, "item").collect()
    assert sorted(r["item"] for r in got) == list(range(len(sizes)))
    made = gapless([(r["sequence_id"], r["offset"], r["length"]) for r in got], 1000)
    best, _ = plain_best_fit(sizes, 1000)
    assert made <= 1.02 * best + 1
