"""Laws that hold for any two small relations."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings, strategies as st

from tallybridge import reconcile
from tests.brute import summary

DDL = "k int, v double, w string"
VALUES = st.tuples(
    st.one_of(st.none(), st.integers(0, 3)),
    st.one_of(st.none(), st.sampled_from([0.0, 1.0, 1.00005, 1.5, float("inf")])),
    st.one_of(st.none(), st.sampled_from(["", "x", "X"])),
)
TABLES = st.lists(VALUES, max_size=12)
FEW = settings(
    max_examples=8,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)


def counts(rec):
    return rec.row_summary().first().asDict()


def matches(rec):
    return {r["column"]: r["matches"] for r in rec.column_stats().collect()}


@FEW
@given(TABLES)
def test_a_relation_is_identical_to_itself(spark, rows):
    df = spark.createDataFrame(rows, DDL)
    assert reconcile(df, df, ["k"]).verdict().first()["identical"] is True


@FEW
@given(TABLES, TABLES)
def test_counts_add_up_and_agree_with_brute_force(spark, left, right):
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    rec = reconcile(a, b, ["k"])
    got = counts(rec)
    assert got["source_rows"] == len(left) == got["source_only"] + got["matched"]
    assert got["target_rows"] == len(right) == got["target_only"] + got["matched"]
    assert got["all_equal"] + got["some_unequal"] == got["matched"]
    expected, per_column = summary(left, right, 1)
    assert {name: got[name] for name in expected} == expected
    stats = rec.column_stats().collect()
    assert all(r["matches"] + r["unequal"] == got["matched"] for r in stats)
    assert [matches(rec)[c] for c in ("v", "w")] == [per_column.get(i, 0) for i in (0, 1)]


@FEW
@given(TABLES, TABLES)
def test_swapping_the_sides_swaps_the_one_sided_rows(spark, left, right):
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    there, back = counts(reconcile(a, b, ["k"])), counts(reconcile(b, a, ["k"]))
    assert there["source_only"] == back["target_only"]
    assert there["target_only"] == back["source_only"]
    assert there["matched"] == back["matched"]


@FEW
@given(TABLES, TABLES)
def test_a_wider_tolerance_never_loses_a_match(spark, left, right):
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    narrow = matches(reconcile(a, b, ["k"], abs_tol=0.00001))
    wide = matches(reconcile(a, b, ["k"], abs_tol=0.6))
    assert all(wide[column] >= n for column, n in narrow.items())


@FEW
@given(TABLES, TABLES)
def test_hot_keys_change_the_plan_but_not_the_result(spark, left, right):
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    plain = reconcile(a, b, ["k"])
    hot = reconcile(a, b, ["k"], hot_key_rows=1, rows_per_range=2)
    assert counts(plain) == counts(hot)
    assert matches(plain) == matches(hot)
