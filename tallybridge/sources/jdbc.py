"""Database scans: connection URLs, drivers and partitioned reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tallybridge.errors import SpecError

# Connection-name markers, URL formats and driver classes.
SQLSERVER_MARKERS = ("sqlserver", "azure_sql", "mssql")
SQLSERVER_URL = "jdbc:sqlserver://{host}:{port};databaseName={service}"
SQLSERVER_DRIVER = "com.microsoft.sqlserver.jdbc.SQLServerDriver"
ORACLE_URL = "jdbc:oracle:thin:@{host}:{port}/{service}"
ORACLE_DRIVER = "oracle.jdbc.driver.OracleDriver"

DEFAULT_FETCH_ROWS = 10_000


@dataclass(frozen=True)
class Connection:
    url: str
    driver: str

    @classmethod
    def named(cls, name: str, host: str, port: int | str, service: str) -> Connection:
        """SQL Server when the name says so, otherwise Oracle."""
        if not name:
            raise SpecError("a database spec needs a connection name")
        sqlserver = any(marker in name for marker in SQLSERVER_MARKERS)
        template = SQLSERVER_URL if sqlserver else ORACLE_URL
        return cls(
            url=template.format(host=host, port=port, service=service),
            driver=SQLSERVER_DRIVER if sqlserver else ORACLE_DRIVER,
        )


@dataclass(frozen=True)
class PartitionPlan:
    """How one remote query is split into concurrent range reads.

    The bounds only place the cuts: rows beyond them, and rows whose column is
    NULL, are read by the first and last partition.
    """

    column: str
    lower: int | str
    upper: int | str
    count: int

    def __post_init__(self) -> None:
        if not self.column or self.count < 1:
            raise SpecError("a partitioned read needs a column and a positive count")

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.count),
        }


def jdbc_options(
    connection: Connection,
    sql: str,
    user: str = "",
    password: str = "",
    partitions: PartitionPlan | None = None,
    fetch_rows: int = DEFAULT_FETCH_ROWS,
) -> dict[str, str]:
    """The statement becomes a derived table, so the database evaluates it.

    Catalyst pushes further filters and the column list on top of it.
    """
    options = {
        "url": connection.url,
        "driver": connection.driver,
        "dbtable": f"({sql.rstrip().rstrip(';')}) alias",
        "fetchsize": str(fetch_rows),
    }
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    return options | (partitions.options() if partitions else {})


def read_jdbc(
    spark: SparkSession,
    connection: Connection,
    sql: str,
    user: str = "",
    password: str = "",
    partitions: PartitionPlan | None = None,
    fetch_rows: int = DEFAULT_FETCH_ROWS,
) -> DataFrame:
    options = jdbc_options(connection, sql, user, password, partitions, fetch_rows)
    return spark.read.format("jdbc").options(**options).load()
