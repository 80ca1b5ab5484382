"""Roles, encoders, sampling and ranking."""

import pytest
from pyspark.sql import functions as F

from veiltab.functions.ranking import hash_bucket, with_position
from veiltab.functions.hashing import uniform
from veiltab.operators import encode as enc
from veiltab.operators import sampling as smp
from veiltab.operators.domain import (
    CATEGORICAL, CONTINUOUS, ORDINAL, Column, Domain, clean_nan, fit_domain, resolve_roles,
)
from veiltab.session import lookup, shared_dir
from veiltab.sources.tables import load, read_domain, save

# A small mixed table: a tree survey with two measurements, a species, a plot number and a flag.
MIXED = [
    (0.25, 3.5, "oak", 7, "no"), (0.5, 6.25, "oak", 30, "no"), (0.7, 0.4, "elm", 30, "yes"),
    (0.33, 9.1, "fir", 55, "yes"), (1.0, 20.0, "ash", 80, "no"), (float("nan"), None, "oak", 12, None),
]
META = {
    "cover": {"type": "float", "lower": 0, "upper": 1}, "height": {"type": "float", "lower": 0, "upper": 20},
    "species": {"type": "string"}, "plot": {"type": "int", "lower": 0, "upper": 80}, "felled": {"type": "string"},
}


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(MIXED, "cover double, height double, species string, plot int, felled string")


def test_roles_from_meta_lists_and_data(mixed):
    assert resolve_roles(mixed, META)["plot"] == ORDINAL
    lists = resolve_roles(mixed, None, ["species", "felled"], ["plot"], ["cover", "height"])
    assert lists == {"cover": CONTINUOUS, "height": CONTINUOUS, "species": CATEGORICAL, "plot": ORDINAL, "felled": CATEGORICAL}
    assert resolve_roles(mixed)["cover"] == CONTINUOUS
    with pytest.raises(ValueError):
        resolve_roles(mixed, {"cover": {"type": "float"}})


def test_encode_decode_round_trip(spark, mixed):
    roles = resolve_roles(mixed, META)
    bounds = {n: (m["lower"], m["upper"]) for n, m in META.items() if "lower" in m}
    d = fit_domain(mixed, roles, bounds, nullable=None)
    assert [c.has_nulls for c in d.columns] == [True, True, False, False, True]
    labels = enc.fit_labels(mixed, ["species", "felled"])
    back = enc.decode(enc.encode(mixed, d, labels), d, labels)
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    want = sorted(repr(tuple(map(near, r))) for r in clean_nan(mixed).collect())
    got = sorted(repr(tuple(map(near, r))) for r in back.collect())
    assert got == want


def test_values_outside_the_bounds_are_clamped(spark):
    df = spark.createDataFrame([(-5.0,), (3.0,), (99.0,)], "x double")
    codes = [r[0] for r in df.select(enc.ordinal_code(F.col("x"), 0, 10)).collect()]
    unit = [r[0] for r in df.select(enc.unit_code(F.col("x"), 0, 10)).collect()]
    assert codes == [0, 3, 10] and unit == [0.0, 0.3, 1.0]


def test_public_labels_do_not_depend_on_the_table(spark, mixed):
    labels = enc.fit_labels(mixed, ["C1"], {"C1": ["ash", "yew"]})
    assert sorted(r["value"] for r in labels.collect()) == ["ash", "yew"]


def test_labels_ranked_by_range_equal_one_window(spark):
    df = spark.range(3000).select((F.col("id") % 997).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"))
    one = enc.fit_labels(df, ["a", "b"], size_bound=1000)
    parted = enc.fit_labels(df, ["a", "b"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, parted.collect()))


def test_domain_operations():
    d = Domain((Column("a", CATEGORICAL, 2), Column("b", ORDINAL, 5), Column("c", CONTINUOUS)))
    assert d.project(["c", "a"]).names == ["c", "a"]
    assert d.complement(["b"]) == ["a", "c"]
    assert d.contains(d.project("b")) and not d.project("b").contains(d)


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_positions_are_exact_for_any_bucketing(spark, buckets):
    df = spark.range(1000).withColumn("u", uniform("s", "t", F.col("id"))).withColumn("g", F.col("id") % 2)
    got = with_position(df, ["u", "id"], hash_bucket(F.col("u"), buckets), out="p").collect()
    order = sorted(got, key=lambda r: (r["u"], r["id"]))
    assert [r["p"] for r in order] == list(range(1000))
    grouped = with_position(df, ["u", "id"], hash_bucket(F.col("u"), buckets), ["g"], "p").collect()
    for g in (0, 1):
        mine = sorted([r for r in grouped if r["g"] == g], key=lambda r: (r["u"], r["id"]))
        assert [r["p"] for r in mine] == list(range(500))


def test_group_positions_keep_null_groups(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") % 2 == 0, F.lit("x")))
    out = smp.stratified_split(df, "g", 0.8, "s", ["id"])
    assert out.count() == 100
    assert sorted((r["g"] or "", r["n"]) for r in out.where("train").groupBy("g").agg(F.count("*").alias("n")).collect()) == [("", 40), ("x", 40)]


def test_folds_and_samples(spark):
    df = spark.range(103)
    sizes = sorted(r["count"] for r in smp.folds(df, 5, "s", ["id"]).groupBy("fold").count().collect())
    assert sizes == [20, 20, 21, 21, 21]
    ids = [r["id"] for r in smp.folds(df, 5, "s", ["id"]).where("fold = 0").collect()]
    assert ids != sorted(ids) or max(b - a for a, b in zip(ids, ids[1:])) > 1  # not contiguous
    assert smp.sample_n(df, 40, "s", ["id"]).distinct().count() == 40
    assert smp.sample_n(df, 500, "s", ["id"]).count() == 500


@pytest.mark.parametrize("rows", [10, 10_000_000])
def test_lookup_with_and_without_broadcast(spark, rows):
    """The salted join of large tables gives the same rows, also for one hot key."""
    df = spark.range(500).withColumn("k", F.when(F.col("id") < 300, F.lit(1)).otherwise(F.col("id") % 5))
    table = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k long, v string")
    out = lookup(df, table, ["k"], rows)
    assert out.count() == 500
    assert out.where("v = 'b'").count() == 300 + 40


def test_save_and_load(spark, sf, tmp_path):
    d = read_domain({"o_orderstatus": {"type": "string", "size": 3}, "o_totalprice": {"type": "float"}})
    t = load(spark, f"{sf}/orders.parquet", d)
    save(t, str(tmp_path / "o"), "csv")
    again = load(spark, str(tmp_path / "o"), d, "csv")
    assert again.exceptAll(t).count() == 0 and again.count() == t.count()
    with pytest.raises(ValueError):
        load(spark, f"{sf}/orders.parquet", read_domain({"nope": {"type": "float"}}))


def test_shared_dir_is_read_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_sample_without_repeats_never_loses_rows(spark):
    df = spark.range(100)
    for n in (99, 100, 101, 5000):
        got = smp.sample_n(df, n, "s", ["id"], replace=False)
        assert got.count() == got.distinct().count() == min(n, 100)


def test_sample_with_replacement_does_not_depend_on_partitions(spark):
    df = spark.range(3000)
    one, two = (sorted(r["id"] for r in smp.sample_fraction(df.repartition(k), 0.4, "s", ["id"], True).collect()) for k in (1, 9))
    assert one == two and 1050 < len(one) < 1350 and len(set(one)) < len(one)


def test_null_keys_spread_over_tasks(spark):
    left = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 50).alias("k"), "id")
    right = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    joined = lookup(left, right, ["k"], 1 << 40)
    assert joined.count() == 40_000 and joined.where("w is null").count() == left.where("k is null").count()
    assert joined.where("k is not null and w <> 2 * k").count() == 0


def test_a_label_beyond_the_size_is_in_no_cell(spark):
    from veiltab.operators.marginals import Marginals

    rows = [(0, 0)] * 3 + [(1, 2)] * 5 + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "a int, b int")
    d = Domain((Column("a", CATEGORICAL, 2, has_nulls=True), Column("b", CATEGORICAL, 2, has_nulls=True)))
    got = {(r["cell"], r["cnt"]) for r in Marginals(d, [("a", "b")], 1).counts(df).collect()}
    assert got == {(0, 3), (2 * 3 + 1, 2)}
    with pytest.raises(ValueError):
        read_domain({"a": {"type": "string"}})


def test_wide_keys(spark):
    from veiltab.operators.marginals import Marginals

    names = ("a", "b", "c", "d")
    d = Domain(tuple(Column(n, ORDINAL, 30_000, 0.0, 29_999.0) for n in names))
    m = Marginals.all_kway(d, 3, 1)
    df = spark.createDataFrame([(29_999, 29_998, 29_997, 1)], ", ".join(f"{n} long" for n in names))
    cells = {r["workload_id"]: (r["cell"], r["cnt"]) for r in m.counts(df).collect()}
    v, k = dict(zip(names, (29_999, 29_998, 29_997, 1))), 30_000
    assert cells == {i: ((v[x] * k + v[y]) * k + v[z], 1) for i, (x, y, z) in enumerate(m.sets)}
    with pytest.raises(ValueError):
        Marginals(d, [names + names[:1]], 1).shift


def test_a_wide_ordinal_needs_no_edge_list():
    c = Column("x", ORDINAL, 10**9)
    assert c.finest(3) == 10**9 and c.coarse(3, 1)[0] == 2
