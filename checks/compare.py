"""Run registered queries on Spark and DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.oracles import ORACLES
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain_value(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain_value(v) for v in value)
    return value


def bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain_value(row[i]) for i in order) for row in rows)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')"
        )
    return connection


def differences(result: DataFrame, connection, sql: str) -> str:
    """Empty when both engines agree; test-sized results only."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} against {sorted(names)}"
    expected = bag(names, cursor.fetchall())
    got = bag(result.columns, [tuple(row) for row in result.collect()])
    if got == expected:
        return ""
    extra, missing = got - expected, expected - got
    return (
        f"{sum(got.values())} rows against {sum(expected.values())}; "
        f"extra {list(extra)[:2]} missing {list(missing)[:2]}"
    )


def main(arguments: list[str]) -> int:
    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    wanted = arguments[1:] or list(QUERIES)
    spark, connection = local_session(), duck(sf_dir)
    failed = 0
    for name in wanted:
        began = time.perf_counter()
        result = QUERIES[name](spark, sf_dir)
        if name in ORACLES:
            problem = differences(result, connection, ORACLES[name])
        else:
            problem = "" if result.count() else "no rows"
        failed += bool(problem)
        taken = time.perf_counter() - began
        print(f"{'FAIL' if problem else 'ok  '} {taken:6.2f}s {name} {problem}", flush=True)
    print(f"{len(wanted) - failed} of {len(wanted)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
