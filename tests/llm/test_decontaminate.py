"""Operator 7 against a plain scan."""

import hashlib
import re

import pytest

from veiltab.llm import decontaminate
from veiltab.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(AZ))


def brute(docs, items, n=10):
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            b = words(t)
            m = min(n, len(b))
            grams = {tuple(b[i : i + m]) for i in range(len(b) - m + 1)} if b else set()
            for i in range(len(w) - m + 1):
                if m and tuple(w[i : i + m]) in grams:
                    hit.update(range(i, i + m))
                    found.add(str(item))
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


ITEMS = [(1, " ".join(f"b{k}" for k in range(25))), (2, "short Item Ünit"), (3, None), (4, ". , !"), (5, "b0 b1 b2 b3 b4 b5 b6 b7 b8 b9"), (5, "short item Ünit"), (None, "no id here")]
DOCS = [
    (1, "x y " + " ".join(f"B{k}" for k in range(3, 15)) + " z", "a"),
    (1, "x y " + " ".join(f"B{k}" for k in range(3, 15)) + " z", "a"),
    (2, "A SHORT-ITEM ünit? Ünit; short.item.Ünit short", "a"),
    (3, None, "a"),
    (4, "", "a"),
    (5, "clean words only", "a"),
    (None, "b0,b1 b2\nb3 b4 b5 b6 b7 b8 b9 b10", "a"),
    (6, "w " * 30000 + " ".join(f"b{k}" for k in range(25)), "a"),
    (7, "no id here", "a"),
]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, spans string"), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("small", [True, False])
def test_equals_plain_scan(tables, monkeypatch, small):
    docs, items = tables
    if not small:  # beyond the size for a broadcast
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.find(docs, items).collect()]
    kept = [(i, t) for i, t in ITEMS if i is not None]
    want = brute([d[:2] for d in DOCS], kept)
    assert sorted(got, key=str) != [] and sorted([g for g in got if g[0] != 7], key=str) == [w for w in want if w[0] != 7]
    assert [g for g in got if g[0] == 7] == [(7, 3, 3, [])]  # an item without id still counts as a hit


def test_empty_sides(tables):
    docs, items = tables
    assert decontaminate.find(docs.limit(0), items).count() == 0
    assert decontaminate.find(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.clean(docs, items.limit(0)).count() == len(DOCS)


def test_documents_and_spans_are_removed(tables):
    docs, items = tables
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    cut = decontaminate.clean(docs, items, mode="spans")
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert texts[1] == "x y z" and texts[2] == "A SHORT-ITEM ünit? Ünit short" and texts[3] is None and texts[5] == "clean words only"
    assert texts[6] == ("w " * 30000).rstrip() and texts[None] == ""


def test_main_path_is_native(spark, sf, capsys):
    QUERIES["op7_decontamination"](spark, sf).explain("formatted")
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", capsys.readouterr().out)


def test_query_equals_sql(spark, sf):
    from tools.check_oracles import compare, connect

    name = "op7_decontamination"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name])[0] is None


def test_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


@pytest.mark.parametrize("room", [None, 0])
def test_hit_rows_are_broadcast_only_while_small(spark, monkeypatch, room):
    if room is not None:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", room)
    items = spark.createDataFrame([("i", "one two three four five six seven eight nine ten")], "item_id string, text string")
    hot = [(None, "x one two three four five six seven eight nine ten y", "a")] * 40 + [(None, "other words", "b")] * 40
    docs = spark.createDataFrame([*hot, (1, None, "c"), (2, "", "d")], "doc_id long, text string, source string").repartition(7)
    assert sorted(r["source"] for r in decontaminate.clean(docs, items).collect()) == ["b"] * 40 + ["c", "d"]
    cut = decontaminate.clean(docs, items, mode="spans").collect()
    assert len(cut) == 82 and sum(r["text"] == "x y" for r in cut) == 40
