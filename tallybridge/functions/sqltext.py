"""Expressions as SQL text.

A comparison of wide tables needs thousands of expressions. Building them as
text and handing Catalyst one statement costs one call into the JVM, where
building them from ``Column`` objects costs several calls per operator.

Text built here has its braces doubled, because ``query`` fills in relations by
name (``FROM {source}``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F


def ident(name: str) -> str:
    return "`" + _doubled(name.replace("`", "``")) + "`"


def text(value: str) -> str:
    return "'" + _doubled(value.replace("\\", "\\\\").replace("'", "\\'")) + "'"


def number(value: float) -> str:
    return f"{float(value)!r}D"


def texts(values: Iterable[str]) -> str:
    return f"CAST(array({', '.join(text(v) for v in values)}) AS ARRAY<STRING>)"


def _doubled(value: str) -> str:
    return value.replace("{", "{{").replace("}", "}}")


def listed(items: Iterable[str]) -> str:
    return ", ".join(items)


def both(conditions: Iterable[str]) -> str:
    """All of them; true when there are none."""
    return " AND ".join(f"({c})" for c in conditions) or "true"


def query(statement: str, **relations: DataFrame) -> DataFrame:
    """The statement over the given relations; nothing runs yet."""
    session = next(iter(relations.values())).sparkSession
    return session.sql(statement, **relations)


def expr(expression: str) -> Column:
    return F.expr(expression.replace("{{", "{").replace("}}", "}"))
