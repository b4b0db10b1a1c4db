"""Nested values: comparable, orderable and printable forms, as SQL text."""

from __future__ import annotations

from pyspark.sql import types as T

from tallybridge.functions.sqltext import ident, listed, text


def contains_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return contains_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(contains_map(field.dataType) for field in dtype.fields)
    return False


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def canonical(value: str, dtype: T.DataType, depth: int = 0) -> str:
    """The value with every map, at any depth, replaced by its sorted entries."""
    if not contains_map(dtype):
        return value
    item = f"x{depth}"
    if isinstance(dtype, T.MapType):
        key = canonical(f"{item}.key", dtype.keyType, depth + 1)
        held = canonical(f"{item}.value", dtype.valueType, depth + 1)
        entry = f"named_struct('key', {key}, 'value', {held})"
        return f"array_sort(transform(map_entries({value}), {item} -> {entry}))"
    if isinstance(dtype, T.ArrayType):
        return f"transform({value}, {item} -> {canonical(item, dtype.elementType, depth + 1)})"
    fields = listed(
        f"{text(f.name)}, {canonical(f'{value}.{ident(f.name)}', f.dataType, depth + 1)}"
        for f in dtype.fields
    )
    return f"IF({value} IS NULL, NULL, named_struct({fields}))"


def as_text(value: str, dtype: T.DataType) -> str:
    """A printable form for reports, delimited output and digests."""
    if isinstance(dtype, T.BinaryType):
        return f"base64({value})"
    if is_nested(dtype):
        options = "map('ignoreNullFields', 'false')"
        json = f"to_json(named_struct('v', {canonical(value, dtype)}), {options})"
        return f"IF({value} IS NULL, NULL, get_json_object({json}, '$.v'))"
    return f"CAST({value} AS STRING)"


def sql_type(dtype: T.DataType) -> str:
    """The type as it is written in a cast."""
    if isinstance(dtype, T.ArrayType):
        return f"ARRAY<{sql_type(dtype.elementType)}>"
    if isinstance(dtype, T.MapType):
        return f"MAP<{sql_type(dtype.keyType)}, {sql_type(dtype.valueType)}>"
    if isinstance(dtype, T.StructType):
        fields = listed(f"{ident(f.name)}: {sql_type(f.dataType)}" for f in dtype.fields)
        return f"STRUCT<{fields}>"
    return dtype.simpleString()
