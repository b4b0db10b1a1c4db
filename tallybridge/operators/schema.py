"""Schema comparison: names, key checks, column sets and type pairs.

Everything here is metadata. The only part that touches rows is
``column_presence``, which counts filled values per column in one pass per side.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from tallybridge.errors import SchemaError
from tallybridge.functions.comparators import is_float, is_integer, is_number, nan_to_null
from tallybridge.functions.nested import contains_map
from tallybridge.functions.sqltext import ident, listed, query, text


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case the column names; names that then clash are an error."""
    lowered = [name.lower() for name in df.columns]
    clashes = sorted(name for name, n in Counter(lowered).items() if n > 1)
    if clashes:
        raise SchemaError(f"column names differ only by case: {', '.join(clashes)}")
    return df if lowered == df.columns else df.toDF(*lowered)


@dataclass(frozen=True)
class Layout:
    """What the two sides have in common, in source column order."""

    keys: tuple[str, ...]
    key_types: tuple[T.DataType, ...]
    source: dict[str, T.DataType]
    target: dict[str, T.DataType]

    @property
    def shared(self) -> list[str]:
        return [name for name in self.source if name in self.target]

    @property
    def source_only(self) -> list[str]:
        return [name for name in self.source if name not in self.target]

    @property
    def target_only(self) -> list[str]:
        return [name for name in self.target if name not in self.source]

    @property
    def compared(self) -> list[str]:
        """Shared columns that are not keys."""
        return [name for name in self.shared if name not in self.keys]

    @property
    def same_columns(self) -> bool:
        return not self.source_only and not self.target_only

    def type_pairs(self) -> list[tuple[str, str, str]]:
        return [
            (name, self.source[name].simpleString(), self.target[name].simpleString())
            for name in self.shared
        ]


def describe(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> Layout:
    """Check the keys against two name-normalised relations."""
    names = [key.lower() for key in keys]
    if not names:
        raise SchemaError("at least one key column is needed")
    if len(set(names)) != len(names):
        raise SchemaError(f"key columns repeat: {', '.join(names)}")
    types = {
        "source": {field.name: field.dataType for field in source.schema},
        "target": {field.name: field.dataType for field in target.schema},
    }
    for side, columns in types.items():
        missing = [name for name in names if name not in columns]
        if missing:
            raise SchemaError(f"{side} has no key column {', '.join(missing)}")
    return Layout(
        keys=tuple(names),
        key_types=tuple(
            _key_type(name, types["source"][name], types["target"][name]) for name in names
        ),
        source=types["source"],
        target=types["target"],
    )


def _key_type(name: str, a: T.DataType, b: T.DataType) -> T.DataType:
    if contains_map(a) or contains_map(b):
        raise SchemaError(f"key {name} holds a map, which has no order")
    if a.simpleString() == b.simpleString():
        return a
    if not (is_number(a) and is_number(b)):
        raise SchemaError(
            f"key {name} is {a.simpleString()} in source and {b.simpleString()} in target"
        )
    if is_integer(a) and is_integer(b):
        return T.LongType()
    if is_float(a) or is_float(b):
        return T.DoubleType()
    parts = [(d.precision - d.scale, d.scale) if isinstance(d, T.DecimalType) else (19, 0)
             for d in (a, b)]
    whole, scale = max(p[0] for p in parts), max(p[1] for p in parts)
    if whole + scale > 38:
        raise SchemaError(f"key {name} needs more than 38 digits to hold both sides")
    return T.DecimalType(whole + scale, scale)


def key_value(name: str, dtype: T.DataType, given: T.DataType | None = None) -> str:
    """A key as it is matched: widened, missing values folded, one zero."""
    value = ident(name)
    if given is None or given.simpleString() != dtype.simpleString():
        value = f"CAST({value} AS {dtype.simpleString()})"
    if is_float(dtype):
        zero = f"CAST(0 AS {dtype.simpleString()})"
        value = nan_to_null(value, dtype)
        value = f"IF({value} = {zero}, {zero}, {value})"
    return value


def column_presence(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per column name: where it lives, its types and its filled values.

    Counts are NULL on a side that lacks the column.
    """
    source, target = normalise_names(source), normalise_names(target)
    return query(
        f"""
        SELECT `column`,
               CASE WHEN max(source_type) IS NULL THEN 'target_only'
                    WHEN max(target_type) IS NULL THEN 'source_only'
                    ELSE 'shared' END AS placement,
               max(source_type) AS source_type, max(target_type) AS target_type,
               max(source_filled) AS source_filled, max(target_filled) AS target_filled
        FROM (SELECT `column`, type AS source_type, filled AS source_filled,
                     CAST(NULL AS STRING) AS target_type, CAST(NULL AS BIGINT) AS target_filled
              FROM ({_filled(source, "source")})
              UNION ALL
              SELECT `column`, CAST(NULL AS STRING), CAST(NULL AS BIGINT), type, filled
              FROM ({_filled(target, "target")}))
        GROUP BY `column`
        """,
        source=source,
        target=target,
    )


def _filled(df: DataFrame, side: str) -> str:
    fields = list(enumerate(df.schema.fields))
    counts = listed(f"count({ident(f.name)}) AS c{i}" for i, f in fields)
    rows = listed(
        f"named_struct('column', {text(f.name)}, "
        f"'type', {text(f.dataType.simpleString())}, 'filled', c{i})"
        for i, f in fields
    )
    return f"SELECT inline(array({rows})) FROM (SELECT {counts} FROM {{{side}}})"
