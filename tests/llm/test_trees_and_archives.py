"""Operators 2 and 8 against plain versions."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veiltab.llm import reply_trees, warc
from veiltab.llm.queries import ORACLES, QUERIES
from veiltab.llm.shared import folder


# ---------------------------------------------------------------- reply trees
def paths(rows):
    """leaf -> nodes from the root, for trees without repeated nodes."""
    parent = {n: p for n, p, *_ in rows}
    known = set(parent)
    inner = {p for p in parent.values() if p in known}
    out = {}
    for leaf in known - inner:
        path, at = [], leaf
        while at in known and at not in path:
            path.append(at)
            at = parent[at]
        if at not in known:
            out[leaf] = path[::-1]
    return out


def forest(seed, n):
    random.seed(seed)
    rows = []
    for k in range(n):
        parent = None if random.random() < 0.1 or not k else random.randrange(max(0, k - 6), k)
        text = random.choice(["plain", "<|im_end|>", "a <\\| b", "<|im_start|>assistant\nx", None, "", "é😀\n\n", "<", "|>", "<\\\\|"])
        rows.append((k, parent, random.choice(["user", "assistant", "sys\ntem", None, "a\\n", "<|x|>\\"]), text, random.choice([0.5, 1.0, None])))
    return rows


@pytest.mark.parametrize("best", [None, 1, 2])
def test_branches(spark, best):
    rows = forest(4, 120) + [(900 + k, 899 + k if k else None, "user", str(k), 0.0) for k in range(70)] + [(2000, 2001, "user", "", 1.0), (2001, 2000, "user", "", 1.0), (3000, 5000, "assistant", "lost parent", 1.0)]
    schema = "node long, parent long, role string, text string, score double"
    made = reply_trees.format_branches(spark.createDataFrame(rows, schema), best)
    turns = reply_trees.read_turns(F.col("formatted"))
    got = {r["leaf"]: r for r in made.withColumn("turns", turns).withColumn("loss", reply_trees.learned(F.col("formatted"), F.col("spans"))).collect()}
    of, want = {r[0]: r for r in rows}, paths(rows)
    score = {leaf: sum(of[n][4] or 0.0 for n in p) for leaf, p in want.items()}
    by_root = {}
    for leaf, p in want.items():
        by_root.setdefault(p[0], []).append(leaf)
    chosen = {leaf: (root, k + 1) for root, own in by_root.items() for k, leaf in enumerate(sorted(own, key=lambda x: (-score[x], x))[:best])}
    assert set(got) == set(chosen)
    for leaf, r in got.items():
        said = [(of[n][2] or "", of[n][3] or "") for n in want[leaf]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == said
        assert r["n_turns"] == len(said) and (r["root"], r["branch"]) == chosen[leaf] and abs(r["score"] - score[leaf]) < 1e-9
        assert r["loss"] == "".join(t for role, t in said if role == "assistant")


def test_tables_without_conversations(spark):
    schema = "node long, parent long, role string, text string, score double"
    assert reply_trees.format_branches(spark.createDataFrame([], schema)).count() == 0
    one = reply_trees.format_branches(spark.createDataFrame([(1, None, "assistant", "x", 1.0)] * 3 + [(None, 1, "user", "no node", 1.0)], schema)).collect()
    assert len(one) == 1 and one[0]["formatted"] == "<|im_start|>assistant\nx<|im_end|>\n"


def test_trees_query_equals_sql(spark, sf):
    from tools.check_oracles import compare, connect

    name = "op2_reply_trees"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])[0] is None


# ---------------------------------------------------------------- archives
@settings(max_examples=200, deadline=None)
@given(runs=st.lists(st.lists(st.integers(0, 9)).map(sorted), max_size=9))
def test_loser_tree(runs):
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


PAGES = [
    (1, "http://www.Example.com/b?q=1#x", "<p>" + "same " * 50), (5, "http://example.com/a", "<p>" + "same " * 50), (3, "https://m.example.org/", "<p>" + "same " * 50),
    (4, None, None), (6, "not a url", ""), (7, "http://a.b/\r\nX: y", "short"), (8, "http://a.b/", "short"), (9, "http://a.b/", "é漢\r\n\r\n😀" * 30),
    (1, "http://www.Example.com/b?q=1#x", "<p>" + "same " * 50), (None, "http://z.z/", "<p>" + "same " * 50), (10, "http://a.b/", "x" * 400000),
]


@pytest.fixture(scope="module")
def archive(spark):
    to = folder(spark, "warc")
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    runs = warc.write_archives(df, to, time=F.timestamp_seconds(F.col("page_id") % 3))
    return to, runs


def test_odd_captures_read_back(archive):
    to, runs = archive
    got = warc.resolved(warc.read_archives(warc.merge_runs(runs), to)).collect()
    raw = {k: (h or "").encode() for k, _, h in PAGES}
    assert sorted(((r["id"] or -1), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (k or -1, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for k, _, h in PAGES
    )
    assert sorted(((r["id"] or -1), r["kind"], r["refers_to"]) for r in got if r["kind"] == "revisit") == [(3, "revisit", 1), (5, "revisit", 1)]
    assert len(raw[10]) == 400000


def test_histories_are_in_order(archive):
    rows = [(r["urlkey"], r["time"] or "", r["id"] if r["id"] is not None else -1) for r in warc.merge_runs(archive[1]).orderBy("rank").collect()]
    assert rows == sorted(rows) and len(rows) == len(PAGES)
    assert [r["rank"] for r in warc.merge_runs(archive[1]).orderBy("rank").collect()] == list(range(len(PAGES)))
    assert ("com,example)/b?q=1", "19700101000001", 1) in rows and ("", "19700101000001", 4) in rows


def test_runs_are_sorted(archive):
    rows = archive[1].collect()
    for run in {r["run"] for r in rows}:
        own = [(r["urlkey"], r["time"] or "", r["id"] or -1) for r in sorted((r for r in rows if r["run"] == run), key=lambda r: r["seq"])]
        assert own == sorted(own)


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    to = folder(spark, "warc")
    runs = warc.write_archives(none, to)
    assert runs.count() == warc.merge_runs(runs).count() == warc.resolved(warc.read_archives(warc.merge_runs(runs), to)).count() == 0


def test_a_cut_record_is_an_error():
    _, raw = warc.record({"refers": None, "payload": "abc", "time": None, "url": None, "digest": "d", "id": None})
    assert warc.parse(raw)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw[:-5])


def test_archives_query_equals_sql(spark, sf):
    from tools.check_oracles import compare, connect

    name = "op8_warc_captures"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])[0] is None
