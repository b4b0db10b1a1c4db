from __future__ import annotations

import os

import pytest

from tallybridge import SpecError
from tallybridge.sources import jdbc
from tallybridge.sources.files import inventory, locate, read_parquet, read_text
from tallybridge.sources.jdbc import Connection, PartitionPlan, jdbc_options
from tallybridge.sources.spec import QUERY, TABLE, TEXT, SourceSpec, read_spec

USERS = {
    "data_base_name": "azure_sql",
    "type": "SQL",
    "query": ["SELECT id, nombre", "FROM usuarios WHERE nombre <> 'a  b'"],
    "key": ["id"],
    "file_name": "usuarios",
}


def test_query_spec_keeps_whitespace_inside_literals():
    spec = SourceSpec.from_dict(USERS)
    assert spec.kind == QUERY
    assert spec.sql() == "SELECT id, nombre FROM usuarios WHERE nombre <> 'a  b'"
    assert (spec.key, spec.file_name) == (("id",), "usuarios")


def test_kinds_are_recognised_as_written():
    assert SourceSpec.from_dict({"type": "txt", "table_name": "x.csv"}).kind == TEXT
    table = {"type": "sql", "table_name": "t", "columns": ["a"], "query": "ignored"}
    assert SourceSpec.from_dict(table).kind == TABLE


def test_table_spec_sql():
    spec = SourceSpec(
        schema="dbo",
        table_name="bags",
        columns=("ID", "Brand1"),
        alias=("id", "brand"),
        filter=("a = 1 OR b = 2", "c = 3"),
    )
    assert spec.sql() == (
        "SELECT ID AS id, Brand1 AS brand FROM dbo.bags WHERE (a = 1 OR b = 2) AND (c = 3)"
    )
    bare = SourceSpec(table_name="bags", columns=("ID", "Brand1"))
    assert bare.sql() == "SELECT ID, Brand1 FROM bags"


@pytest.mark.parametrize(
    "spec",
    [
        {"type": "SQL"},
        {"type": "SQL", "query": "  "},
        {"table_name": "t"},
        {"columns": ["a"]},
        {"table_name": "t", "columns": ["a", "b"], "alias": ["x"]},
        {"type": "TXT"},
        {"type": "SQL", "query": "SELECT 1", "quer": "typo"},
    ],
)
def test_bad_specs(spec):
    with pytest.raises(SpecError):
        SourceSpec.from_dict(spec)


def test_text_spec_ignores_columns_and_aliases(tmp_path, spark):
    path = tmp_path / "bags.csv"
    path.write_text("ID;Brand;Price\n1;x;2.5\n2;y;3.0\n")
    spec = SourceSpec.from_dict(
        {
            "type": "TXT",
            "table_name": str(path),
            "delimiter": ";",
            "columns": ["ID", "Brand", "Price"],
            "alias": ["Brand"],
        }
    )
    df = read_spec(spark, spec)
    assert df.dtypes == [("ID", "int"), ("Brand", "string"), ("Price", "double")]
    assert df.count() == 2


def test_text_without_header_and_with_schema(tmp_path, spark):
    path = tmp_path / "raw.txt"
    path.write_text("1|2024-01-02\n2|\n")
    inferred = read_text(spark, str(path), "|", header=False)
    assert inferred.columns == ["_c0", "_c1"]
    typed = read_text(spark, str(path), "|", header=False, schema="id bigint, day date")
    assert typed.dtypes == [("id", "bigint"), ("day", "date")]
    assert typed.where("day IS NULL").count() == 1


def test_input_path_wins_over_table_name():
    spec = SourceSpec(kind=TEXT, input_path="a.csv", table_name="b.csv")
    assert spec.location == "a.csv"


def test_password_is_not_shown():
    assert "hush" not in repr(SourceSpec(table_name="t", columns=("a",), password="hush"))


def test_session_specs(spark, rows):
    spark.createDataFrame([(1, "a", 5), (2, "b", 6), (3, "c", 7)], "id int, n string, q int") \
        .createOrReplaceTempView("spec_rows")
    spec = SourceSpec(
        table_name="spec_rows",
        columns=("id", "q * 2", "n"),
        alias=("key", "twice", "name"),
        filter=("q > 5", "n = 'b' OR n = 'c'"),
    )
    assert rows(read_spec(spark, spec)) == [(2, 12, "b"), (3, 14, "c")]
    query = SourceSpec(kind=QUERY, query="SELECT n, '{x}  y' AS tag FROM spec_rows WHERE id = 1")
    assert rows(read_spec(spark, query)) == [("a", "{x}  y")]


def test_connections():
    server = Connection.named("azure_sql", "h", 1433, "db")
    assert server.url == "jdbc:sqlserver://h:1433;databaseName=db"
    assert server.driver == jdbc.SQLSERVER_DRIVER
    oracle = Connection.named("oracle_19c", "h", 1521, "svc")
    assert oracle.url == "jdbc:oracle:thin:@h:1521/svc"
    assert oracle.driver == jdbc.ORACLE_DRIVER
    with pytest.raises(SpecError):
        Connection.named("", "h", 1, "s")


def test_jdbc_options():
    connection = Connection("jdbc:x", "d")
    plain = jdbc_options(connection, "SELECT 1;", user="u", password="p")
    assert plain["dbtable"] == "(SELECT 1) alias"
    assert (plain["user"], plain["password"]) == ("u", "p")
    split = jdbc_options(connection, "SELECT 1", partitions=PartitionPlan("id", 1, 100, 8))
    assert split["partitionColumn"] == "id" and split["numPartitions"] == "8"
    assert (split["lowerBound"], split["upperBound"]) == ("1", "100")
    assert "user" not in split and int(split["fetchsize"]) > 0
    with pytest.raises(SpecError):
        PartitionPlan("id", 1, 2, 0)


def test_unknown_connection(spark):
    with pytest.raises(SpecError):
        read_spec(spark, SourceSpec.from_dict(USERS), {})


def test_a_named_connection_reads_over_jdbc(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(
        "tallybridge.sources.spec.read_jdbc",
        lambda spark, connection, sql, **rest: seen.update(sql=sql, at=connection, **rest),
    )
    server = Connection.named("azure_sql", "h", 1433, "db")
    plan = PartitionPlan("id", 0, 10, 2)
    read_spec(spark, SourceSpec.from_dict(USERS, partitions=plan), {"azure_sql": server})
    assert seen["at"] is server and seen["partitions"] is plan
    assert seen["sql"].startswith("SELECT id")


def test_locate(spark, tmp_path):
    place = tmp_path / "b" / "data.parquet"
    spark.range(3).write.parquet(str(place))
    roots = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert locate(spark, str(place)) == str(place)
    assert locate(spark, "/nowhere/data.parquet/", roots) == str(place)
    assert read_parquet(spark, "/nowhere/data.parquet", roots).count() == 3
    with pytest.raises(FileNotFoundError):
        locate(spark, "/nowhere/other.parquet", roots)


def test_inventory(spark, tmp_path, plan):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.bin").write_bytes(b"12345")
    (tmp_path / "two.bin").write_bytes(b"1")
    listing = inventory(spark, str(tmp_path))
    assert {r["name"]: r["bytes"] for r in listing.collect()} == {"one.bin": 5, "two.bin": 1}
    assert "content" not in plan(listing)
    assert os.path.basename(listing.where("bytes = 5").first()["path"]) == "one.bin"


def test_text_specs_choose_quotes_and_splitting(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,v\n" + "".join(f"{i},'it\\'s {i}, here'\n" for i in range(20_000)))
    given = {"type": "TXT", "input_path": str(path)}
    options = {"quote": "'", "escape": "\\", "text_schema": "id long, v string"}
    split = read_spec(spark, SourceSpec.from_dict(given, multi_line=False, **options))
    whole = read_spec(spark, SourceSpec.from_dict(given, **options))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert split.rdd.getNumPartitions() > 2 and whole.rdd.getNumPartitions() == 1
        assert split.count() == whole.count() == 20_000
        assert split.where("v = concat('it', chr(39), 's ', id, ', here')").count() == 20_000
        assert split.exceptAll(whole).isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
