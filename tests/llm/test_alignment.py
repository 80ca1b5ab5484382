"""Operator 11 against both libraries on whole texts."""

import base64
import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import numpy as np
import pyarrow as pa

from veiltab.llm import align
from veiltab.llm.queries import QUERIES
from veiltab.llm.text import column_bytes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = {int(k): base64.b64decode(t) for t, k in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
ODD = ["a", "B", "é", " ", " ", "\n", "\t", "'s", "'", "0", "12", ".", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "▁", " ", "　", "\u0085", "漢", "😀", " the", "\x00", "qx", "ﬁ"]


@cache
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@cache
def aligner():
    return align.Aligner(A, B)


def plain_groups(text, a, b):
    """[(ids of A, ids of B)] by sets of end offsets, or [] where the bytes differ."""
    if not text:
        return []
    whole = " " + text
    ids_a, ids_b = a.encode(whole, add_special_tokens=False).ids, b.encode(text)
    parts_a = [RANKS[k] for k in ids_a]
    parts_b = [bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
    if b"".join(parts_a) != whole.encode() or b"".join(parts_b) != whole.encode():
        return []
    ends_a, ends_b = np.cumsum([len(p) for p in parts_a]), np.cumsum([len(p) for p in parts_b])
    out, x, y = [], 0, 0
    for end in sorted({*ends_a.tolist()} & {*ends_b.tolist()}):
        i, j = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
        out.append((ids_a[x:i], ids_b[y:j]))
        x, y = i, j
    return out


def shown(groups):
    return ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)


def plain_measures(texts):
    a, b = tools()
    groups = {t: plain_groups(t, a, b) for t in {*texts}}
    count = Counter((x[-1], y[-1]) for t in texts for x, y in groups[t])
    most = defaultdict(int)
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for t in texts:
        links = [(x[-1], y[-1]) for x, y in groups[t]]
        out.append((
            sum(len(x) for x, _ in groups[t]), sum(len(y) for _, y in groups[t]), len(groups[t]), len(links),
            sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), shown(groups[t]),
        ))
    return out, count


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(ODD), max_size=30).map("".join), st.text(max_size=20)), max_size=6))
def test_fragments_align_as_whole_texts(texts):
    a, b = tools()
    found, groups, row, pair, times = aligner().rows(*column_bytes(pa.array(texts, pa.string())))
    want = [plain_groups(t, a, b) for t in texts]
    assert ["" if g is None else g.decode() for g in groups] == [shown(g) for g in want]
    assert found.tolist() == [[sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g)] for g in want]
    links = Counter()
    for r, p, n in zip(row.tolist(), pair.tolist(), times.tolist()):
        links[r, p >> 32, p & 0xFFFFFFFF] += n
    assert links == Counter((r, x[-1], y[-1]) for r, g in enumerate(want) for x, y in g)


def test_edge_rows(spark):
    random.seed(4)
    long = " ".join(random.choice(["one", "Two", "dé", "x1", "  ", "\n\n", "unfathomable"]) for _ in range(30_000))
    solid = "".join(random.choice("abc") for _ in range(6000))
    texts = ["", None, " ", "   ", "a ", "same text", "same text", "same text", "x▁y", "<|endoftext|> z", long, solid, "a\tb\x00"]
    rows = [(k if k != 3 else None, t, "text", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, pairs int")
    got, pairs = align.align(docs, A, B, whole=True)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    got = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    want, count = plain_measures([t or "" for t in texts])
    assert got == {(k if k != 3 else None): w for k, w in enumerate(want)}
    assert {(r["a"], r["b"]): r["count"] for r in pairs.collect()} == dict(count)
    assert align.align(docs.limit(0), A, B)[0].count() == 0


def test_query_and_hot_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    want, _ = plain_measures([*texts.values()])
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_alignment"](spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert got == {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for k, w in zip(texts, want)}
    # a third of all rows hold one text
    hot = docs.union(spark.range(100).select(F.col("id") + 10_000, F.lit("one text, in very many rows")))
    rows = {r["doc_id"]: r["text"] or "" for r in hot.collect()}
    want, _ = plain_measures([*rows.values()])
    got = {r["doc_id"]: tuple(r)[1:7] for r in align.align(hot, A, B)[0].collect()}
    assert got == {k: w[:6] for k, w in zip(rows, want)}


def test_pair_counts_too_large_to_send(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, align.align(docs, A, B)[0].collect()))
    monkeypatch.setattr("veiltab.session.BROADCAST_BYTES", 1)
    assert sorted(map(tuple, align.align(docs, A, B)[0].collect())) == want


def test_a_model_with_spaces_inside_pieces_is_refused(monkeypatch):
    class Odd:
        def __init__(self, model_file):
            pass

        def vocab_size(self):
            return 1

        def id_to_piece(self, k):
            return "a▁b"

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        align.Aligner(A, B)
