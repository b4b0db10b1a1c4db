"""Every registered query against DuckDB, or at least for rows."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks.compare import differences
from checks.oracles import ORACLES
from checks.queries import QUERIES


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_parts_of_a_publication_grow_with_the_table(spark, tmp_path):
    lines = spark.range(3_000).selectExpr("id AS l_orderkey", "CAST(id % 7 AS INT) AS l_linenumber")
    lines.repartition(12).write.parquet(str(tmp_path / "lineitem.parquet"))
    # One task for every file.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        published = QUERIES["q39_published_dataset"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(published.inputFiles()) >= 12
    assert sorted(published.collect()) == sorted(lines.collect())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duckdb_tables, name):
    result = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert differences(result, duckdb_tables, ORACLES[name]) == ""
    else:
        assert result.count() > 0


def test_entry(spark):
    stats = __spark_entry__.entry(spark)
    assert {r["column"]: r["matches"] for r in stats.collect()} == {
        "order_id": 1470,
        "cust_id": 1470,
        "status": 1345,
        "total": 1209,
        "order_date": 1470,
    }


def test_inventory_lists_the_folder(spark, sf_dir):
    import os

    listed = {r["name"]: r["bytes"] for r in QUERIES["q07_inventory"](spark, sf_dir).collect()}
    expected = {
        name: os.path.getsize(os.path.join(sf_dir, name)) for name in os.listdir(sf_dir)
    }
    assert listed == expected
