"""Declarative source specifications and the relations they stand for.

A spec names one side of a comparison: a query, a projection of a table, or a
delimited text file, either at a remote database or among the tables this
Spark session already knows. Specs are plain driver-side values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tallybridge.errors import SpecError
from tallybridge.functions.sqltext import ident, listed, query
from tallybridge.sources.files import read_text
from tallybridge.sources.jdbc import Connection, PartitionPlan, read_jdbc

QUERY, TABLE, TEXT = "query", "table", "text"

# Spec field names and type names that existing spec files use.
FIELD_NAMES = (
    "data_base_name",
    "type",
    "query",
    "columns",
    "alias",
    "schema",
    "table_name",
    "filter",
    "key",
    "file_name",
    "user",
    "password",
    "input_path",
    "delimiter",
    "header",
)
QUERY_TYPE = "SQL"
TEXT_TYPE = "TXT"


@dataclass(frozen=True)
class SourceSpec:
    """One side of a comparison. Build it directly or with ``from_dict``."""

    kind: str = TABLE
    query: str = ""
    columns: tuple[str, ...] = ()
    alias: tuple[str, ...] = ()
    schema: str = ""
    table_name: str = ""
    filter: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    file_name: str = ""
    connection_name: str = ""
    user: str = ""
    password: str = field(default="", repr=False)
    input_path: str = ""
    delimiter: str = ","
    header: bool = True
    text_schema: str = ""
    quote: str = '"'
    escape: str = '"'
    # Without line breaks in fields Spark can split one large file among tasks.
    multi_line: bool = True
    partitions: PartitionPlan | None = None

    def __post_init__(self) -> None:
        if self.kind == QUERY and not self.query.strip():
            raise SpecError("a query spec needs a query")
        if self.kind == TABLE:
            if not self.table_name:
                raise SpecError("a table spec needs a table_name")
            if not self.columns:
                raise SpecError("a table spec needs at least one column")
            if self.alias and len(self.alias) != len(self.columns):
                raise SpecError(
                    f"{len(self.columns)} columns but {len(self.alias)} aliases"
                )
        if self.kind == TEXT and not self.location:
            raise SpecError("a text spec needs an input_path or a table_name")

    @classmethod
    def from_dict(cls, spec: Mapping, **extra) -> SourceSpec:
        """Read the field names used by spec files; ``extra`` adds our own."""
        unknown = sorted(set(spec) - set(FIELD_NAMES))
        if unknown:
            raise SpecError(f"unknown spec fields: {', '.join(unknown)}")
        named = spec.get("type") or ""
        # The text type is recognised in any case, the query type only in capitals.
        if named.upper() == TEXT_TYPE:
            kind = TEXT
        else:
            kind = QUERY if named == QUERY_TYPE else TABLE
        query = spec.get("query") or ""
        plain = {
            name: spec[name]
            for name in (
                "schema", "table_name", "file_name", "user", "password",
                "input_path", "delimiter", "header",
            )
            if spec.get(name) is not None
        }
        return cls(
            kind=kind,
            query=query if isinstance(query, str) else " ".join(query),
            columns=_names(spec.get("columns")),
            alias=_names(spec.get("alias")),
            filter=_names(spec.get("filter")),
            key=_names(spec.get("key")),
            connection_name=spec.get("data_base_name") or "",
            **plain,
            **extra,
        )

    @property
    def location(self) -> str:
        return self.input_path or self.table_name

    @property
    def relation(self) -> str:
        return f"{self.schema}.{self.table_name}" if self.schema else self.table_name

    def sql(self) -> str:
        """The statement a database runs. Whitespace inside it is left alone."""
        if self.kind == QUERY:
            return self.query
        if self.kind == TEXT:
            raise SpecError("a text spec has no SQL form")
        names = self.alias or (None,) * len(self.columns)
        shown = [c if name is None else f"{c} AS {name}" for c, name in zip(self.columns, names)]
        statement = f"SELECT {', '.join(shown)} FROM {self.relation}"
        conditions = " AND ".join(f"({text})" for text in self.filter)
        return statement + (f" WHERE {conditions}" if conditions else "")


def _names(value: str | Sequence[str] | None) -> tuple[str, ...]:
    """A single text is a list of one."""
    return (value,) if isinstance(value, str) else tuple(value or ())


def read_spec(
    spark: SparkSession,
    spec: SourceSpec,
    connections: Mapping[str, Connection] | None = None,
) -> DataFrame:
    """The relation a spec describes; nothing is read yet.

    A spec that names a connection runs at that database. One that names none
    runs over the tables and views of this session.
    """
    if spec.kind == TEXT:
        relation = read_text(
            spark, spec.location, spec.delimiter, spec.header, spec.text_schema or None,
            spec.quote, spec.escape, spec.multi_line,
        )
        # A list of aliases that doesn't fit the columns leaves a text file's own names.
        if spec.columns and len(spec.alias) in (0, len(spec.columns)):
            return project(relation, spec)
        for condition in spec.filter:
            relation = relation.where(condition)
        return relation
    if spec.connection_name:
        known = connections or {}
        if spec.connection_name not in known:
            raise SpecError(f"no connection named {spec.connection_name}")
        return read_jdbc(
            spark,
            known[spec.connection_name],
            spec.sql(),
            user=spec.user,
            password=spec.password,
            partitions=spec.partitions,
        )
    if spec.kind == QUERY:
        return spark.sql(spec.query)
    return project(spark.table(spec.relation), spec)


def project(relation: DataFrame, spec: SourceSpec) -> DataFrame:
    """Filter, then project and rename; the filter sees the original columns."""
    names = spec.alias or (None,) * len(spec.columns)
    known = set(relation.columns)
    for condition in spec.filter:
        relation = relation.where(condition)
    shown = [ident(c) if c in known else _as_written(c) for c in spec.columns]
    picked = listed(
        c if name is None else f"{c} AS {ident(name)}" for c, name in zip(shown, names)
    )
    return query(f"SELECT {picked} FROM {{relation}}", relation=relation)


def _as_written(expression: str) -> str:
    return expression.replace("{", "{{").replace("}", "}}")


__all__ = ["QUERY", "TABLE", "TEXT", "SourceSpec", "project", "read_spec"]
