"""Matching, duplicates and hot keys against a row-by-row comparison."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tallybridge.operators import keys as keys_module, stats as stats_module
from tallybridge import reconcile
from tallybridge.operators.keys import (
    HOT_KEY_ROWS,
    MAX_SAMPLE_BYTES,
    SAMPLES_PER_RANGE,
    duplicate_keys,
    key_ordinals,
    range_count,
    sorted_ranges,
)
from tallybridge.operators import match
from tallybridge.operators.schema import describe
from tallybridge.workspace import Workspace
from tests.brute import classify, summary

DDL = "k1 string, k2 int, v double, w string"


def table(seed, n, keys, hot=0.0):
    """Rows with repeating keys; a share of them sits under one NULL key."""
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        if pick.random() < hot:
            key = (None, 1)
        else:
            key = (pick.choice(["a", "b", None]), pick.choice([None, *range(keys)]))
        rows.append((*key, pick.choice([None, 0.5, 1.0, 2.0]), pick.choice([None, "x", "y"])))
    return rows


def check(spark, source, target, **options):
    a, b = spark.createDataFrame(source, DDL), spark.createDataFrame(target, DDL)
    rec = reconcile(a, b, ["k1", "k2"], **options)
    expected, matches = summary(source, target, 2)
    counts = rec.row_summary().first().asDict()
    assert {name: counts[name] for name in expected} == expected
    got = {r["column"]: r["matches"] for r in rec.column_stats().collect()}
    assert (got["v"], got["w"]) == (matches.get(0, 0), matches.get(1, 0))
    rows = sorted(
        [
            (
                (r["_k0"], r["_k1"]),
                r["_ord"],
                (r["_s0"], r["_s1"]) if r["_in_s"] else None,
                (r["_t0"], r["_t1"]) if r["_in_t"] else None,
            )
            for r in rec.classified.collect()
        ],
        key=repr,
    )
    assert rows == sorted(classify(source, target, 2), key=repr)
    return rec


def test_duplicates_and_null_keys(spark):
    rec = check(spark, table(1, 60, 4), table(2, 50, 4))
    assert not rec.key_profile.unique
    assert rec.key_profile.hot_hashes == ()


def test_hot_keys_split_in_ranges(spark):
    source, target = table(3, 300, 6, hot=0.4), table(4, 260, 6, hot=0.5)
    rec = check(spark, source, target, hot_key_rows=20, rows_per_range=25)
    assert len(rec.key_profile.hot_hashes) >= 1
    assert rec.key_profile.source_rows == 300


def test_every_key_hot(spark):
    rec = check(spark, table(5, 120, 2), table(6, 90, 2), hot_key_rows=1, rows_per_range=10)
    assert rec.key_profile.hot_rows > 150


def test_exact_copies_of_one_row(spark):
    source = [("a", 1, 1.0, "x")] * 70 + [("b", 1, 2.0, "y")]
    target = [("a", 1, 1.0, "x")] * 50 + [("c", 1, 2.0, "y")]
    rec = check(spark, source, target, hot_key_rows=10, rows_per_range=8)
    assert rec.source_only_rows().count() == 21


def test_one_side_empty(spark):
    check(spark, [], table(7, 20, 3))
    check(spark, table(7, 20, 3), [])


def test_both_sides_empty(spark):
    empty = spark.createDataFrame([], DDL)
    rec = reconcile(empty, empty, ["k1", "k2"])
    assert rec.verdict().first()["identical"] is True
    stats = rec.column_stats().collect()
    assert [r["percent"] for r in stats] == [None] * 4
    assert rec.matched_sample().count() == 0


def test_no_matched_rows(spark):
    a = spark.createDataFrame([("a", 1, 1.0, "x")], DDL)
    b = spark.createDataFrame([("b", 1, 1.0, "x")], DDL)
    rec = reconcile(a, b, ["k1", "k2"])
    assert {r["percent"] for r in rec.column_stats().collect()} == {None}
    assert rec.verdict().first()["identical"] is False


def test_unique_null_key_pairs(spark):
    a = spark.createDataFrame([(None, 1, 1.0, "x"), ("a", None, 2.0, "y")], DDL)
    b = spark.createDataFrame([(None, 1, 1.0, "x"), ("a", None, 2.5, "y")], DDL)
    rec = reconcile(a, b, ["k1", "k2"])
    assert rec.key_profile.unique
    assert rec.row_summary().first()["matched"] == 2
    assert rec.source_only_rows().count() == 0


def test_nulls_in_different_key_columns_are_different_keys(spark):
    rows = [(None, 1, 1.0, "x"), ("1", None, 1.0, "x")]
    a = spark.createDataFrame(rows, DDL)
    layout = describe(a, a, ["k1", "k2"])
    assert match.profile(a, a, layout).unique


def test_float_keys(spark):
    nan = float("nan")
    a = spark.createDataFrame([(0.0, "x"), (nan, "y")], "k double, v string")
    b = spark.createDataFrame([(-0.0, "x"), (nan, "y")], "k double, v string")
    rec = reconcile(a, b, ["k"])
    assert rec.row_summary().first()["all_equal"] == 2


def test_keys_of_different_numeric_types(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(1.0, "x"), (2.5, "y")], "k double, v string")
    rec = reconcile(a, b, ["k"])
    assert rec.row_summary().first()["matched"] == 1
    assert rec.source_only_rows().dtypes == [("k", "int"), ("v", "string")]
    assert rec.stored().source_only_rows().dtypes == [("k", "int"), ("v", "string")]


def test_wide_keys_and_long_texts_order_rows(spark):
    """Values that differ only far into a long text keep a fixed pairing."""
    long = "z" * 500
    source = [("a", 1, None, long + tail) for tail in "cab"]
    target = [("a", 1, None, long + tail) for tail in "bca"]
    a, b = spark.createDataFrame(source, DDL), spark.createDataFrame(target, DDL)
    for options in ({}, {"hot_key_rows": 1, "rows_per_range": 1}):
        rec = reconcile(a, b, ["k1", "k2"], **options)
        assert rec.row_summary().first()["all_equal"] == 3


def test_long_hot_keys(spark):
    """Keys that agree in their first characters stay apart."""
    ddl = "k string, v int"
    keys = ["q" * 300 + tail for tail in "ab"]
    source = [(key, i) for key in keys for i in range(40)]
    target = [(key, i) for key in keys for i in range(30)]
    a, b = spark.createDataFrame(source, ddl), spark.createDataFrame(target, ddl)
    rec = reconcile(a, b, ["k"], hot_key_rows=5, rows_per_range=7)
    counts = rec.row_summary().first()
    assert (counts["all_equal"], counts["source_only"]) == (60, 20)


def test_many_columns_fold_into_a_digest(spark):
    names = [f"c{i}" for i in range(12)]
    ddl = "k int, " + ", ".join(f"{n} int" for n in names)
    source = [(1, *[0] * 11, i) for i in range(5)]
    a = spark.createDataFrame(source, ddl)
    b = spark.createDataFrame(source[::-1], ddl)
    rec = reconcile(a, b, ["k"])
    assert rec.row_summary().first()["all_equal"] == 5


def test_duplicates_with_nested_values_and_different_types(spark):
    ddl_a = "k int, m map<string,int>, n int, s struct<`x y`:int>, only array<int>"
    ddl_b = "k int, m map<string,int>, n string, s struct<`x y`:int>"
    source = [(1, {"a": i, "b": 1}, i, (i,), [i]) for i in range(6)]
    target = [(1, {"b": 1, "a": i}, str(i), (i,)) for i in reversed(range(6))]
    a, b = spark.createDataFrame(source, ddl_a), spark.createDataFrame(target, ddl_b)
    for options in ({}, {"hot_key_rows": 2, "rows_per_range": 2}):
        rec = reconcile(a, b, ["k"], **options).stored()
        assert rec.row_summary().first()["all_equal"] == 6
        rec.close()


def test_row_order_and_partitioning_do_not_matter(spark, rows):
    source, target = table(8, 80, 4), table(9, 80, 4)
    results = []
    for shuffle in range(3):
        pick = random.Random(shuffle)
        pick.shuffle(source)
        pick.shuffle(target)
        a = spark.createDataFrame(source, DDL).repartition(shuffle + 1)
        b = spark.createDataFrame(target, DDL).repartition(5 - shuffle)
        results.append(rows(reconcile(a, b, ["k1", "k2"]).matched_rows()))
    assert results[0] == results[1] == results[2]


def test_duplicate_keys(spark, rows):
    df = spark.createDataFrame(
        [(None, 1), (None, 2), ("a", 1), ("b", 1), ("b", 1), ("b", 3)], "K string, v int"
    )
    assert rows(duplicate_keys(df, ["k"])) == [("b", 3), (None, 2)]


def test_key_ordinals(spark, rows):
    values = [("a", i % 3, i) for i in range(9)] + [("b", None, 1), (None, 5, 5)]
    df = spark.createDataFrame(values, "k string, x int, y int")
    expected = []
    for key in ("a", "b", None):
        own = sorted((v for v in values if v[0] == key), key=lambda v: (v[1] is not None, v[1], v[2]))
        expected += [(*v, i + 1) for i, v in enumerate(own)]
    assert rows(key_ordinals(df, ["k"])) == sorted(expected, key=repr)
    hot = key_ordinals(df, ["k"], hot_key_rows=3, rows_per_range=2)
    assert rows(hot) == sorted(expected, key=repr)


def test_key_profile_can_be_reused(spark):
    source, target = table(1, 30, 3), table(2, 30, 3)
    a, b = spark.createDataFrame(source, DDL), spark.createDataFrame(target, DDL)
    first = reconcile(a, b, ["k1", "k2"])
    again = reconcile(a, b, ["k1", "k2"], key_profile=first.key_profile)
    assert again.row_summary().collect() == first.row_summary().collect()


@pytest.mark.parametrize("width", [10, 300, 5_000])
def test_range_sample_is_bounded(width):
    ranges = range_count(10**12, 1_000_000, width)
    assert ranges >= 2
    assert ranges * SAMPLES_PER_RANGE * width <= MAX_SAMPLE_BYTES
    assert range_count(HOT_KEY_ROWS, 1_000_000, width) == 2


def test_the_sample_of_a_large_sort_of_texts_stays_small():
    """Six million texts of 2.7 KB, for which the cluster would rather have 600 tasks."""
    ranges = range_count(6_200_000, 400_000, 2_700, fewest=600)
    assert 16 <= ranges <= 600 and ranges * SAMPLES_PER_RANGE * 2_700 <= 200_000_000


@pytest.mark.parametrize("hot_key_rows", [100, 10**6])
def test_tasks_hold_few_rows_however_well_copies_compress(spark, monkeypatch, hot_key_rows):
    monkeypatch.setattr(keys_module, "ROWS_PER_TASK", 400)
    # Copies of one key if it is hot, two copies of every key if none is.
    key = "0L" if hot_key_rows == 100 else "id DIV 2"
    rows = spark.range(8_000).selectExpr(f"{key} AS k", "'copy' AS flag")
    rec = reconcile(rows, rows, ["k"], hot_key_rows=hot_key_rows)
    assert bool(rec.key_profile.hot_hashes) == (hot_key_rows == 100)
    status = rec.row_status().selectExpr("status", "spark_partition_id() AS task")
    held = status.groupBy("task").count().collect()
    assert sum(n for _, n in held) == 8_000 and max(n for _, n in held) <= 800
    assert {r["status"] for r in status.select("status").distinct().collect()} == {"matched"}


@pytest.mark.parametrize("sample", [2, 3, 5])
def test_ranges_are_split_until_they_hold_few_rows(spark, tmp_path, monkeypatch, sample):
    """Sort keys so wide that one sort may have only a few ranges."""
    width = 1000
    monkeypatch.setattr(keys_module, "MAX_SAMPLE_BYTES", sample * SAMPLES_PER_RANGE * width)
    pick = random.Random(sample)
    values = [pick.randrange(40) for _ in range(400)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, _tie long").repartition(3)
    placed, ranges = sorted_ranges(rows, 400, ("v", "_tie"), width, 30, 2, Workspace(spark, str(tmp_path)))
    found = placed.orderBy("_range", "_pos").collect()
    assert [(r["v"], r["_tie"]) for r in found] == sorted((v, i) for i, v in enumerate(values))
    sizes = Counter(r["_range"] for r in found)
    assert max(sizes.values()) <= 60 and max(sizes) < ranges


def test_wide_hot_keys_pair_whatever_the_sample_allows(spark, monkeypatch):
    monkeypatch.setattr(keys_module, "MAX_SAMPLE_BYTES", 1)
    source, target = table(3, 300, 6, hot=0.4), table(4, 260, 6, hot=0.5)
    check(spark, source, target, hot_key_rows=60, rows_per_range=60)


@pytest.mark.parametrize("width", [1, 2**20, 2**40])
def test_ranges_are_bounded_in_bytes(spark, tmp_path, monkeypatch, width):
    monkeypatch.setattr(keys_module, "MAX_SAMPLE_BYTES", 2**50)
    monkeypatch.setattr(keys_module, "RANGE_BYTES", 8 * 2**20)
    rows = spark.range(64).selectExpr("id AS v")
    _, ranges = sorted_ranges(rows, 64, ("v",), width, 1000, 2, Workspace(spark, str(tmp_path)))
    assert ranges == {1: 2, 2**20: 8, 2**40: 64}[width]


@pytest.mark.parametrize("per_row", [1, 3, 9, 32])
def test_wide_tables_are_measured_in_groups(spark, monkeypatch, per_row):
    monkeypatch.setattr(stats_module, "COLUMNS_A_ROW", per_row)
    ddl = "k int, " + ", ".join(f"c{i} int" for i in range(8))
    a = spark.createDataFrame([(k, *range(8)) for k in range(4)], ddl)
    b = spark.createDataFrame([(k, *[i + (i == k) for i in range(8)]) for k in range(4)], ddl)
    stats = reconcile(a, b, ["k"]).column_stats().orderBy("position").collect()
    assert [r["column"] for r in stats] == ["k", *[f"c{i}" for i in range(8)]]
    assert [r["unequal"] for r in stats] == [0, 1, 1, 1, 1, 0, 0, 0, 0]


def test_three_hundred_columns(spark):
    names = [f"c{i}" for i in range(300)]
    ddl = "k int, " + ", ".join(f"{n} {('int', 'string', 'double')[i % 3]}" for i, n in enumerate(names))
    kinds = (int, str, float)

    def side(change):
        return spark.createDataFrame([(k, *[kinds[i % 3](i + (change and k == i)) for i in range(300)]) for k in range(20)], ddl)

    rec = reconcile(side(False), side(True), ["k"])
    lazy = rec.column_stats().orderBy("position").collect()
    assert {r["column"]: r["unequal"] for r in lazy if r["unequal"]} == {f"c{i}": 1 for i in range(20)}
    kept = rec.stored()
    assert kept.column_stats().orderBy("position").collect() == lazy
    kept.close()


def test_samples_are_the_first_mismatches_of_every_column(spark):
    """More columns than one row of the aggregate keeps, copies of a key and NULL keys."""
    names = [f"c{i}" for i in range(70)]
    ddl = "k string, j int, " + ", ".join(f"{n} int" for n in names)
    pick = random.Random(4)
    source = [(pick.choice("abc") if k % 9 else None, k % 5, *[k] * 69, 7) for k in range(60)]
    target = [(*r[:2], *[v + (pick.random() < 0.3) * 1000 for v in r[2:-1]], r[-1]) for r in source]
    rec = reconcile(spark.createDataFrame(source, ddl), spark.createDataFrame(target, ddl), ["k", "j"])
    expected = []
    for name in names:
        rows = rec.matched_rows().where(f"NOT {name}_match")
        found = rows.selectExpr("k", "j", f"{name}_original", f"{name}_new").collect()
        expected.append((name, found))
    got = rec.mismatch_samples(4).collect()
    for name, found in expected:
        keys = sorted(((r[0] is not None, r[0] or "", r[1]) for r in found))[:4]
        mine = sorted((r for r in got if r["column"] == name), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(keys) + 1))
        assert [(r["k"] is not None, r["k"] or "", r["j"]) for r in mine] == keys
        values = {(r[0], r[1], str(r[2]), str(r[3])) for r in found}
        assert all((r["k"], r["j"], r["value_original"], r["value_new"]) in values for r in mine)
    assert not [r for r in got if r["column"] == "c69"]


def test_samples_without_shared_values(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 2)], "k int, y int")
    assert reconcile(a, b, ["k"]).mismatch_samples().collect() == []


def test_long_equal_beginnings_do_not_mispair(spark):
    """Copies whose texts differ only far in, under repeating keys, on both paths."""
    head = "x" * 70
    source = [(k, f"{head}{k}{c}", c) for k in range(40) for c in range(2)]
    target = [(k, f"{text}." if c else text, c) for k, text, c in source]
    ddl = "k int, body string, n int"
    for limit in (1, 1000):
        rec = reconcile(
            spark.createDataFrame(source, ddl), spark.createDataFrame(target, ddl), ["k"],
            hot_key_rows=limit, rows_per_range=10,
        )
        unequal = {r["column"]: r["unequal"] for r in rec.column_stats().collect()}
        assert (unequal["body"], unequal["n"]) == (40, 0)


def test_many_columns_and_differing_types_pair_by_value(spark):
    values = [(k, *[(k * 7 + c * 3 + i) % 5 for i in range(10)]) for k in range(50) for c in range(2)]
    names = ", ".join(f"c{i} int" for i in range(1, 10))
    a = spark.createDataFrame(values, f"k int, c0 int, {names}")
    b = spark.createDataFrame([(r[0], float(r[1]), *r[2:]) for r in values], f"k int, c0 double, {names}")
    for limit in (1, 1000):
        rec = reconcile(a, b, ["k"], hot_key_rows=limit, rows_per_range=20)
        assert {r["unequal"] for r in rec.column_stats().collect()} == {0}


def test_a_column_may_be_called_like_an_internal_one(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "id int, _k0 int")
    b = spark.createDataFrame([(1, 5)], "id int, _k0 int")
    assert [tuple(r) for r in reconcile(a, b, ["id"]).source_only_rows().collect()] == [(2, 6)]
