from __future__ import annotations

import pytest

from tallybridge import SchemaError, reconcile
from tallybridge.operators.schema import column_presence, describe, normalise_names


def frame(spark, ddl, *values):
    return spark.createDataFrame(list(values), ddl)


def test_names_and_keys_ignore_case(spark):
    a = frame(spark, "ID int, Brand string", (1, "x"))
    b = frame(spark, "id int, BRAND string", (1, "x"))
    rec = reconcile(a, b, ["Id"])
    assert rec.verdict().first()["identical"] is True
    assert rec.matched_rows().columns == ["id", "brand_original", "brand_new", "brand_match"]


def test_names_that_clash_after_lowering(spark):
    with pytest.raises(SchemaError):
        normalise_names(frame(spark, "a int, A int", (1, 2)))


@pytest.mark.parametrize("keys", [[], ["nope"], ["id", "ID"]])
def test_bad_keys(spark, keys):
    a = frame(spark, "id int, v int", (1, 2))
    with pytest.raises(SchemaError):
        reconcile(a, a, keys)


def test_key_types(spark):
    def key_type(left, right):
        a, b = frame(spark, f"k {left}"), frame(spark, f"k {right}")
        return describe(a, b, ["k"]).key_types[0].simpleString()

    assert key_type("int", "bigint") == "bigint"
    assert key_type("int", "double") == "double"
    assert key_type("decimal(10,2)", "int") == "decimal(21,2)"
    for left, right in (("int", "string"), ("date", "timestamp"), ("map<int,int>", "map<int,int>")):
        with pytest.raises(SchemaError):
            key_type(left, right)


def test_column_sets_and_presence(spark, rows):
    a = frame(spark, "id int, v int, old string", (1, None, "x"), (2, 3, "y"))
    b = frame(spark, "id bigint, v int, fresh string", (1, 2, None))
    layout = describe(a, b, ["id"])
    assert (layout.shared, layout.source_only, layout.target_only) == (
        ["id", "v"],
        ["old"],
        ["fresh"],
    )
    assert layout.type_pairs() == [("id", "int", "bigint"), ("v", "int", "int")]
    assert rows(column_presence(a, b)) == [
        ("fresh", "target_only", None, "string", None, 0),
        ("id", "shared", "int", "bigint", 2, 1),
        ("old", "source_only", "string", None, 2, None),
        ("v", "shared", "int", "int", 1, 1),
    ]


def test_awkward_names(spark):
    ddl = "`a.b` int, `c{d}` string, `e``f` double, `it's` string, `x\\y` int"
    a = frame(spark, ddl, (1, "x", 1.0, "q", 1), (2, "y", 2.0, "r", 2))
    b = frame(spark, ddl, (1, "x", 1.0, "q", 1), (2, "z", 2.0, "r", 2))
    rec = reconcile(a, b, ["A.B"])
    stats = {r["column"]: r["matches"] for r in rec.column_stats().collect()}
    assert stats == {"a.b": 2, "c{d}": 1, "e`f": 2, "it's": 2, "x\\y": 2}
    assert "c{d}_match" in rec.matched_rows().columns
    assert rec.mismatch_samples().first()["column"] == "c{d}"


def test_clashing_output_names(spark):
    a = frame(spark, "id int, v int, v_new int", (1, 2, 3))
    b = frame(spark, "id int, v int", (1, 2))
    with pytest.raises(SchemaError):
        reconcile(a, b, ["id"]).matched_rows()


def test_untyped_null_column(spark):
    a = spark.sql("SELECT 1 AS id, NULL AS v")
    rec = reconcile(a, a, ["id"]).stored()
    assert rec.verdict().first()["identical"] is True
    rec.close()
