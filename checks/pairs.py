"""Pairs of relations derived from the test tables, as SQL both engines run.

Each side reads its whole table. Conditions on a key drop single rows from one
side and CASE branches alter single values: they are the differences to find.
"""

from __future__ import annotations

from dataclasses import dataclass
from string import Formatter

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Pair:
    source: str
    target: str
    keys: tuple[str, ...]

    def load(self, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        return load(spark, sf_dir, self.source), load(spark, sf_dir, self.target)

    def ctes(self) -> str:
        """The two sides as DuckDB common table expressions."""
        return f"WITH source AS ({plain(self.source)}), target AS ({plain(self.target)})"


def tables_in(sql: str) -> set[str]:
    return {name for _, name, _, _ in Formatter().parse(sql) if name}


def plain(sql: str) -> str:
    return sql.format(**{name: name for name in tables_in(sql)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in tables_in(sql)})


# Unique key, every kind of difference.
ORDERS = Pair(
    keys=("order_id",),
    source="""
SELECT o_orderkey AS order_id, o_custkey AS cust_id,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE o_totalprice END AS total,
       o_orderdate AS order_date, o_orderpriority AS priority
FROM {orders} WHERE o_orderkey % 101 <> 0""",
    target="""
SELECT o_orderkey AS order_id, o_custkey AS cust_id,
       CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 THEN NULL
            WHEN o_orderkey % 31 = 0 THEN 'X' ELSE o_orderstatus END AS status,
       CASE WHEN o_orderkey % 43 = 0 OR o_orderkey % 23 = 0 THEN NULL
            WHEN o_orderkey % 7 = 0 THEN o_totalprice + CAST(1.25 AS DOUBLE)
            WHEN o_orderkey % 5 = 0 THEN o_totalprice + CAST(0.00005 AS DOUBLE)
            ELSE o_totalprice END AS total,
       o_orderdate AS order_date, 'legacy' AS channel
FROM {orders} WHERE o_orderkey % 97 <> 0""",
)

# Duplicate keys.
LINES = Pair(
    keys=("l_orderkey", "l_linenumber"),
    source="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM {lineitem}""",
    target="""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_partkey % 19 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity,
       l_extendedprice
FROM {lineitem} WHERE l_suppkey % 29 <> 0""",
)

# Column types that differ between the sides.
TYPES = Pair(
    keys=("id",),
    source="""
SELECT c_custkey AS id, c_acctbal AS bal, c_nationkey AS nation, c_mktsegment AS seg,
       (c_custkey % 2 = 0) AS flag, TIMESTAMP '2024-01-01 00:00:00' AS ts
FROM {customer}""",
    target="""
SELECT c_custkey AS id,
       CASE WHEN c_custkey % 11 = 0 THEN 'n/a'
            WHEN c_custkey % 7 = 0 THEN CAST(c_acctbal + 1 AS STRING)
            ELSE CAST(c_acctbal AS STRING) END AS bal,
       CASE WHEN c_custkey % 5 = 0 THEN CAST(c_nationkey AS DOUBLE) + CAST(0.00005 AS DOUBLE)
            WHEN c_custkey % 6 = 0 THEN CAST(c_nationkey AS DOUBLE) + CAST(0.5 AS DOUBLE)
            ELSE CAST(c_nationkey AS DOUBLE) END AS nation,
       CASE WHEN c_custkey % 13 = 0 THEN LOWER(c_mktsegment) ELSE c_mktsegment END AS seg,
       CASE WHEN c_custkey % 17 = 0 THEN 7 ELSE CAST(c_custkey % 2 = 0 AS INT) END AS flag,
       CASE WHEN c_custkey % 9 = 0 THEN 'bad' WHEN c_custkey % 10 = 0 THEN '2024-01-02'
            ELSE '2024-01-01' END AS ts
FROM {customer}""",
)

# A timestamp against an integer: no rule makes these comparable.
INCOMPARABLE = Pair(
    keys=("id",),
    source="SELECT id, seg, ts FROM (" + TYPES.source + ") AS s",
    target="SELECT id, seg, flag AS ts FROM (" + TYPES.target + ") AS t",
)

# NULL keys, several per side.
NULL_KEYS = Pair(
    keys=("id",),
    source="""
SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS id,
       c_name AS name, c_acctbal AS bal FROM {customer}""",
    target="""
SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS id,
       c_name AS name, c_acctbal AS bal FROM {customer} WHERE c_custkey % 100 <> 0""",
)

# Array values.
VECTORS = Pair(
    keys=("vec_id",),
    source="SELECT vec_id, embedding, label FROM {embeddings}",
    target="""
SELECT vec_id,
       CASE WHEN vec_id % 7 = 0 THEN reverse(embedding) ELSE embedding END AS embedding,
       CASE WHEN vec_id % 11 = 0 THEN label + 1 ELSE label END AS label
FROM {embeddings}""",
)

# Long texts, one of them altered at its very end.
TEXTS = Pair(
    keys=("doc_id",),
    source="SELECT doc_id, text, lang, n_chars FROM {documents}",
    target="""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN concat(text, '.') ELSE text END AS text,
       lang, n_chars FROM {documents}""",
)

# Five key values share the whole table, so every key is hot.
HOT_KEYS = Pair(
    keys=("event_type",),
    source="SELECT event_type, ts, event_id, user_id, value FROM {events}",
    target="""
SELECT event_type, ts, event_id, user_id,
       CASE WHEN event_id % 11 = 0 THEN value + 1 ELSE value END AS value
FROM {events} WHERE event_id % 89 <> 0""",
)

# Every column of the events, the JSON texts too, under the same few keys.
WHOLE_EVENTS = Pair(
    keys=("event_type",),
    source="SELECT event_type, event_id, ts, user_id, value, props FROM {events}",
    target="""
SELECT event_type, event_id, ts, user_id, value,
       CASE WHEN event_id % 13 = 0 THEN concat(props, ' ') ELSE props END AS props
FROM {events} WHERE event_id % 97 <> 0""",
)

# More columns than one row of an aggregate measures.
WIDE_COLUMNS = 100
WIDE = Pair(
    keys=("o_orderkey",),
    source="SELECT o_orderkey, "
    + ", ".join(f"o_totalprice + {i} AS c{i}" for i in range(WIDE_COLUMNS))
    + " FROM {orders}",
    target="SELECT o_orderkey, "
    + ", ".join(
        f"CASE WHEN o_orderkey % {i + 7} = 0 THEN NULL WHEN o_orderkey % {i + 2} = 0 THEN o_totalprice "
        f"ELSE o_totalprice + {i} END AS c{i}"
        for i in range(WIDE_COLUMNS)
    )
    + " FROM {orders} WHERE o_orderkey % 101 <> 0",
)

# A third of the rows are exact copies of each other under one NULL key.
COPIES = Pair(
    keys=("id",),
    source="""
SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END AS id,
       CASE WHEN l_orderkey % 3 = 0 THEN 'copy' ELSE l_returnflag END AS flag,
       CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END AS part
FROM {lineitem}""",
    target="""
SELECT CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END AS id,
       CASE WHEN l_orderkey % 3 = 0 THEN 'copy' ELSE l_returnflag END AS flag,
       CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_partkey END AS part
FROM {lineitem} WHERE l_suppkey % 29 <> 0""",
)

# Equal sides; equal columns and unequal values; rows that one side lacks.
_SUPPLIERS = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM {supplier}"
SAME = Pair(keys=("s_suppkey",), source=_SUPPLIERS, target=_SUPPLIERS)
UNEQUAL = Pair(
    keys=("s_suppkey",),
    source=_SUPPLIERS,
    target="""
SELECT s_suppkey, s_name, s_nationkey,
       CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal
FROM {supplier}""",
)
ONE_SIDED_PAIR = Pair(
    keys=("s_suppkey",), source=_SUPPLIERS, target=_SUPPLIERS + " WHERE s_suppkey % 5 <> 0"
)

# Decimals of 38 digits, against each other and against whole numbers, just within and
# just beyond the tolerance.
DECIMALS = Pair(
    keys=("l_orderkey", "l_partkey", "l_suppkey"),
    source="""
SELECT l_orderkey, l_partkey, l_suppkey,
       CAST(concat('12345678901234567', CAST(l_linenumber AS STRING), '.0001') AS DECIMAL(38, 10)) AS wide,
       9007199254740993 + l_partkey AS whole
FROM {lineitem}""",
    target="""
SELECT l_orderkey, l_partkey, l_suppkey,
       CAST(concat('12345678901234567', CAST(l_linenumber AS STRING),
                   CASE WHEN l_partkey % 3 = 0 THEN '.1001' WHEN l_partkey % 3 = 1 THEN '.00015'
                        ELSE '.0001' END) AS DECIMAL(38, 10)) AS wide,
       CAST(9007199254740993 + l_partkey - CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 0 END
            AS DECIMAL(38, 10)) AS whole
FROM {lineitem}""",
)

# Ten value columns under a repeating key, one of differing types.
WHOLE_LINES = Pair(
    keys=("l_orderkey",),
    source="SELECT * FROM {lineitem}",
    target="""
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag,
       CASE WHEN l_partkey % 23 = 0 THEN 'X' ELSE l_linestatus END AS l_linestatus, l_shipdate
FROM {lineitem}""",
)

# Whole documents under a repeating key; some texts differ at their very end.
REPEATED_TEXTS = Pair(
    keys=("lang",),
    source="SELECT lang, text, source, n_chars, doc_id FROM {documents}",
    target="""
SELECT lang, CASE WHEN doc_id % 10 = 0 THEN concat(text, '.') ELSE text END AS text,
       source, n_chars, doc_id FROM {documents}""",
)
