"""Whole rows under names that can't clash with an operator's own columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def sealed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named by their places, and the name that each column has there."""
    names = [f"_in{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def opened(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``sealed`` rows under their own names, without any others."""
    return rows.select(*names.values()).toDF(*names)
