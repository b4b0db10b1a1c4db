"""Counts that two engines agreed on for the derived pairs, see FIXTURES.md."""

from __future__ import annotations

import pytest

from checks.pairs import LINES, NULL_KEYS, ORDERS, TYPES
from tallybridge import reconcile

ROWS = {
    ("orders", "0.001"): (15, 14, 1470),
    ("orders", "0.01"): (153, 147, 14698),
    ("lines", "0.001"): (545, 0, 5455),
    ("lines", "0.01"): (2423, 0, 57577),
    ("types", "0.001"): (0, 0, 150),
    ("types", "0.01"): (0, 0, 1500),
    ("null_keys", "0.001"): (2, 0, 148),
    ("null_keys", "0.01"): (15, 0, 1485),
}
MATCHES = {
    ("orders", "0.001"): {"cust_id": 1470, "order_date": 1470, "status": 1345, "total": 1209},
    ("orders", "0.01"): {"cust_id": 14698, "order_date": 14698, "status": 13488, "total": 12114},
    ("lines", "0.001"): {"l_partkey": 5324, "l_quantity": 5059},
    ("lines", "0.01"): {"l_partkey": 56934, "l_quantity": 53856},
    ("types", "0.001"): {"bal": 116, "nation": 130, "seg": 138, "flag": 141, "ts": 120},
    ("types", "0.01"): {"bal": 1168, "nation": 1300, "seg": 1384, "flag": 1411, "ts": 1200},
    ("null_keys", "0.001"): {"name": 147, "bal": 147},
    ("null_keys", "0.01"): {"name": 1470, "bal": 1470},
}
PAIRS = {"orders": ORDERS, "lines": LINES, "types": TYPES, "null_keys": NULL_KEYS}


@pytest.mark.parametrize(("name", "scale"), list(ROWS))
def test_counts(spark, name, scale):
    pair = PAIRS[name]
    source, target = pair.load(spark, f"/root/testdata/sf{scale}")
    rec = reconcile(source, target, pair.keys)
    counts = rec.row_summary().first()
    assert (counts["source_only"], counts["target_only"], counts["matched"]) == ROWS[name, scale]
    matches = {r["column"]: r["matches"] for r in rec.column_stats().collect()}
    expected = MATCHES[name, scale]
    assert {column: matches[column] for column in expected} == expected
    assert all(matches[key] == counts["matched"] for key in pair.keys)


def test_order_differences(spark):
    source, target = ORDERS.load(spark, "/root/testdata/sf0.01")
    rec = reconcile(source, target, ORDERS.keys)
    stats = {r["column"]: r for r in rec.column_stats().collect()}
    assert stats["total"]["max_diff"] == pytest.approx(1.25, abs=1e-9)
    assert (stats["total"]["null_diff"], stats["status"]["null_diff"]) == (625, 798)
    assert rec.row_summary().first()["some_unequal"] == 3575
    assert rec.verdict().first()["identical"] is False


def test_null_key_pairs(spark):
    source, target = NULL_KEYS.load(spark, "/root/testdata/sf0.01")
    rec = reconcile(source, target, NULL_KEYS.keys)
    assert rec.matched_rows().where("id IS NULL").count() == 15
