"""One value against one value, for every rule and its edges."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tallybridge import Tolerance, reconcile

INF, NAN = float("inf"), float("nan")

# type, value, type, value, match
CASES = [
    ("double", 1.0, "double", 1.00005, True),
    ("double", 1.0, "double", 1.0002, False),
    # Binary doubles decide the edge: one of these is just above the tolerance.
    ("double", 1.0, "double", 1.0001, True),
    ("double", 100.0, "double", 100.0001, False),
    ("double", INF, "double", INF, True),
    ("double", INF, "double", -INF, False),
    ("double", INF, "double", 1.0, False),
    ("double", 0.0, "double", -0.0, True),
    ("double", NAN, "double", NAN, True),
    ("double", NAN, "double", None, True),
    ("double", NAN, "double", 1.0, False),
    ("double", None, "double", None, True),
    ("double", None, "double", 0.0, False),
    ("float", 1.5, "double", 1.5, True),
    ("bigint", 2**53, "bigint", 2**53 + 1, False),
    ("bigint", 2**63 - 1, "bigint", -(2**63), False),
    ("bigint", 7, "bigint", 7, True),
    ("int", 3, "double", 3.00001, True),
    ("tinyint", 3, "bigint", 3, True),
    ("boolean", True, "int", 1, True),
    ("boolean", True, "int", 7, False),
    ("boolean", False, "double", 0.0, True),
    ("boolean", True, "boolean", False, False),
    ("decimal(10,4)", Decimal("1.0000"), "decimal(10,4)", Decimal("1.0001"), True),
    ("decimal(10,4)", Decimal("100.0000"), "decimal(10,4)", Decimal("100.0001"), True),
    ("decimal(10,4)", Decimal("1.0000"), "decimal(10,4)", Decimal("1.0002"), False),
    ("decimal(38,10)", Decimal("1.5"), "decimal(38,10)", Decimal("1.5"), True),
    ("decimal(10,2)", Decimal("5.00"), "int", 5, True),
    ("decimal(10,2)", None, "int", None, True),
    ("string", "a", "string", "a", True),
    ("string", "a", "string", "A", False),
    ("string", "a", "string", "a ", False),
    ("string", None, "string", "", False),
    ("double", 1.5, "string", "1.5", True),
    ("string", " 1.50001 ", "double", 1.5, True),
    ("double", 1.5, "string", "n/a", False),
    ("double", None, "string", "n/a", False),
    ("double", None, "string", None, True),
    ("double", None, "string", "NaN", True),
    ("double", 1.5, "string", "1.5d", False),
    ("double", 1.0, "string", "1F", False),
    ("double", INF, "string", "inf", True),
    ("bigint", 12, "string", "12", True),
    ("date", dt.date(2024, 1, 2), "date", dt.date(2024, 1, 2), True),
    ("date", dt.date(2024, 1, 2), "timestamp_ntz", dt.datetime(2024, 1, 2), True),
    ("timestamp_ntz", dt.datetime(2024, 1, 2), "string", "2024-01-02", True),
    ("string", "2024-01-02 00:00:01", "timestamp", dt.datetime(2024, 1, 2), False),
    ("timestamp_ntz", dt.datetime(2024, 1, 2), "string", "soon", False),
    ("timestamp_ntz", None, "string", "soon", False),
    ("timestamp_ntz", None, "string", None, True),
    ("date", dt.date(2024, 1, 2), "string", "2024-01-02", True),
    ("int", 1, "date", dt.date(2024, 1, 2), False),
    ("int", None, "date", None, True),
    ("boolean", True, "string", "true", False),
    ("array<int>", [1, 2], "array<int>", [1, 2], True),
    ("array<int>", [1, 2], "array<int>", [2, 1], False),
    ("array<int>", None, "array<int>", None, True),
    ("array<int>", [1], "string", "[1]", False),
    ("map<string,int>", {"a": 1, "b": 2}, "map<string,int>", {"b": 2, "a": 1}, True),
    ("map<string,int>", {"a": 1}, "map<string,int>", {"a": 2}, False),
    (
        "struct<p:map<string,int>,q:int>",
        ({"a": 1, "b": 2}, 1),
        "struct<p:map<string,int>,q:int>",
        ({"b": 2, "a": 1}, 1),
        True,
    ),
    ("array<map<string,int>>", [{"a": 1}], "array<map<string,int>>", [{"a": 2}], False),
    ("binary", b"ab", "binary", b"ab", True),
]


def sides(spark, cases):
    """All cases as one wide row per side, a column per case."""

    def side(offset):
        schema = T._parse_datatype_string(
            ", ".join(["k int"] + [f"c{i} {case[offset]}" for i, case in enumerate(cases)])
        )
        return spark.createDataFrame([(1, *[case[offset + 1] for case in cases])], schema)

    return side(0), side(2)


def test_every_rule(spark):
    rec = reconcile(*sides(spark, CASES), ["k"])
    row = rec.matched_rows().first()
    wrong = [case for i, case in enumerate(CASES) if row[f"c{i}_match"] is not case[4]]
    assert wrong == []


def test_differences(spark):
    cases = [
        ("double", 1.0, "double", 3.5, 2.5),
        ("double", INF, "double", INF, None),
        ("double", None, "double", 3.5, None),
        ("int", 1, "string", "4", 3.0),
        ("string", "a", "string", "b", 0.0),
        ("decimal(10,2)", Decimal("1.25"), "decimal(10,2)", Decimal("1.00"), 0.25),
        ("boolean", True, "int", 0, 1.0),
    ]
    rec = reconcile(*sides(spark, cases), ["k"])
    stats = {r["column"]: r for r in rec.column_stats().collect()}
    assert [stats[f"c{i}"]["max_diff"] for i in range(len(cases))] == [c[4] for c in cases]
    assert stats["c2"]["null_diff"] == 1


def test_relative_tolerance(spark):
    cases = [
        ("double", 100.0, "double", 109.0, True),
        ("double", 100.0, "double", 112.0, False),
        ("double", 1.0, "double", INF, False),
        ("bigint", 100, "bigint", 109, True),
        ("decimal(10,2)", Decimal("100"), "decimal(10,2)", Decimal("109"), True),
    ]
    rec = reconcile(*sides(spark, cases), ["k"], abs_tol=0.0, rel_tol=0.1)
    row = rec.matched_rows().first()
    assert [row[f"c{i}_match"] for i in range(len(cases))] == [c[4] for c in cases]


def test_tolerance_is_checked():
    with pytest.raises(ValueError):
        Tolerance(-1.0)
    with pytest.raises(ValueError):
        Tolerance(0.0, INF)
