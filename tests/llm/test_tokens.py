"""Operators 4, 5 and 10 against the tokenizers library, one text at a time."""

import hashlib
import json
import random
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veiltab.llm import bpe, token_counts, token_files
from veiltab.llm.fragments import json_encoder
from veiltab.llm.queries import QUERIES
from veiltab.llm.shared import folder
from veiltab.llm.text import column_bytes

import pyarrow as pa

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = ["a", "B", "é", " ", "\n", "\t", "'s", "'", "0", "12", ".", ",", "!", "<|endoftext|>", "<|", "|>", " ", "　", "\u0085", "́", "漢", "😀", "İ", "ß", " the", "\x1c", "$", "qx"]
EDGE = ["", None, " ", "\n\n\n", "a" * 5000, " " * 3000, "ab" * 3000, "don't  stop", "x<|endoftext|> y", "same", "same", "é" * 900 + "   b"]


def library(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    tok.no_truncation()
    tok.no_padding()
    return tok


def ids_of(encoder, texts):
    out = []
    for _, ids, at in encoder.rows(*column_bytes(pa.array(texts, pa.string()))):
        out += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    return out


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.one_of(st.lists(st.sampled_from(ODD), max_size=30).map("".join), st.text(max_size=20)), max_size=6))
def test_fragments_equal_whole_texts(name, texts):
    tok = library(name)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(json_encoder(public_tokenizers.path(name)), texts) == want
    if name == "byte_bpe_50k.json":
        model = bpe.model(public_tokenizers.path(name))
        assert ids_of(model.encoder, texts) == want


def test_edge_texts_and_long_pieces():
    tok, model = library(FILES[0]), bpe.model(public_tokenizers.path(FILES[0]))
    random.seed(3)
    texts = [*EDGE, "".join(random.choice("abcdefgh") for _ in range(4000)), "=" * 700]
    assert ids_of(model.encoder, texts) == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_marked_pairs_lie_inside_no_token():
    model = bpe.model(public_tokenizers.path(FILES[0]))
    for token in model.token[: model.size - 1]:
        assert not any(model.cut_pair[a, b] for a, b in zip(token, token[1:]))


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(k, t, "src", 0.5) for k, t in enumerate(EDGE)] + [(3, "tie", "src", 0.5), (3, "tie", "src", 0.5), (None, "no key", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_tokens double")


def test_round_trip_of_a_table(spark, edge):
    path = public_tokenizers.path(FILES[0])
    back = bpe.decode(bpe.encode(edge, path), path)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in back.collect())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in edge.collect())
    assert got == want


def test_empty_tables(spark, edge):
    path, none = public_tokenizers.path(FILES[0]), edge.limit(0)
    assert bpe.encode(none, path).count() == bpe.digests(none, path).count() == 0
    assert token_counts.count_tokens(none, path, folder(spark, "t")).count() == 0
    to = folder(spark, "t")
    token_files.write_tokens(none, path, 2, to)
    assert token_files.read_tokens(spark, to).count() == 0


def test_digests_query(spark, sf):
    tok = library(FILES[0])
    got = {r["doc_id"]: r for r in QUERIES["op10_bpe_round_trip"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == want


def test_counts_and_cache(spark, edge):
    path, cache = public_tokenizers.path(FILES[0]), folder(spark, "cache")
    tok = library(FILES[0])
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in edge.collect())
    first = token_counts.count_tokens(edge.limit(5), path, cache)
    assert first.count() == 5
    one = spark.read.parquet(cache).count()
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in token_counts.count_tokens(edge, path, cache).collect())
    assert got == want
    texts = len({r["text"] or "" for r in edge.collect()})
    assert one < texts and spark.read.parquet(cache).count() == texts  # only misses were appended
    other = token_counts.count_tokens(edge, public_tokenizers.path(FILES[1]), cache)  # another version: nothing stored
    assert other.count() == len(want) and spark.read.parquet(cache).count() == 2 * texts


def test_counts_query(spark, sf):
    tok = library(FILES[0])
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op4_token_counts"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        assert got.pop(r["doc_id"]) == (len((r["text"] or "").encode()), n, n > 1024)
    assert not got


def test_files_query(spark, sf):
    tok = library(FILES[1])
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op5_token_files"](spark, sf).collect()}
    start = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        assert got.pop(r["doc_id"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_files_of_odd_rows(spark, edge):
    to, tok = folder(spark, "files"), library(FILES[1])
    token_files.write_tokens(edge.repartition(5), public_tokenizers.path(FILES[1]), 2, to, parts=4)
    got = token_files.read_tokens(spark, to).orderBy("start").collect()
    keys = [r["key"] for r in got]
    assert keys[0] is None and keys[1:] == sorted(keys[1:]) and len(got) == edge.count()
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got[:-1]]]).tolist()
    want = sorted([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in edge.collect())
    assert sorted(r["ids"] for r in got) == want
    assert spark.read.parquet(f"{to}/manifest").agg(F.sum("documents")).first()[0] == len(got)


def runs(spark, cache):
    """The folders that runs wrote below a cache."""
    return sorted({r["_metadata"]["file_path"].rsplit("/", 1)[0] for r in spark.read.parquet(cache).select("_metadata").distinct().collect()})


def test_a_second_run_encodes_nothing(spark, edge):
    path, cache = public_tokenizers.path(FILES[0]), folder(spark, "cache")
    first = sorted(map(tuple, token_counts.count_tokens(edge.drop("n_tokens", "key"), path, cache).na.fill(-1).collect()))
    before = runs(spark, cache)
    again = sorted(map(tuple, token_counts.count_tokens(edge.drop("n_tokens", "key"), path, cache).na.fill(-1).collect()))
    assert again == first and runs(spark, cache) == before and len(before) == 1


def test_runs_that_write_at_once(spark, edge):
    path, cache = public_tokenizers.path(FILES[0]), folder(spark, "cache")
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda _: sorted(map(tuple, token_counts.count_tokens(edge, path, cache).na.fill(-1).collect())), range(4)))
    assert all(g == got[0] for g in got) and len(got[0]) == edge.count()


ADDED = ["[USER: a]", "[USER: a] [x]", "<|endoftext|>", "a!b", "\n\n##", "é ."]


@pytest.fixture(scope="module")
def with_added(tmp_path_factory):
    """The byte-level file with added tokens that hold spaces and marks."""
    with open(public_tokenizers.path(FILES[0]), encoding="utf-8") as f:
        spec = json.load(f)
    like = spec["added_tokens"][0]
    spec["added_tokens"] += [like | {"id": 50257 + k, "content": w} for k, w in enumerate(w for w in ADDED if w != like["content"])]
    path = tmp_path_factory.mktemp("added") / "tokenizer.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*ODD, *ADDED, "[USER:", " a]", "##", "USER"]), max_size=20).map("".join), max_size=6))
def test_added_tokens_with_spaces_and_marks(with_added, texts):
    tok = Tokenizer.from_file(with_added)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(json_encoder(with_added), texts) == want
    assert ids_of(bpe.model(with_added).encoder, texts) == want


@pytest.mark.parametrize("change", [
    {"pre_tokenizer": None},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}},
    {"normalizer": {"type": "NFC"}},
    {"model": {"ignore_merges": True}},
    {"added_tokens": {"lstrip": True}},
    {"added_tokens": {"single_word": True}},
])
def test_unknown_rules_are_refused(tmp_path, change):
    with open(public_tokenizers.path(FILES[0]), encoding="utf-8") as f:
        spec = json.load(f)
    for part, value in change.items():
        if part == "model":
            spec["model"] |= value
        elif part == "added_tokens":
            spec["added_tokens"][0] |= value
        else:
            spec[part] = value
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    for make in (bpe.model, json_encoder):
        with pytest.raises(ValueError):
            make(str(path))


def test_forced_boundaries_need_byte_level():
    with pytest.raises(ValueError):
        bpe.model(public_tokenizers.path(FILES[1]))
