"""Deterministic samples for reports: the first rows in key order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.internal import InternalFunction

from tallybridge.functions.comparators import Comparison
from tallybridge.functions.nested import as_text
from tallybridge.functions.sqltext import expr, ident, listed, query, texts
from tallybridge.operators.keys import SOURCE, TARGET
from tallybridge.operators.match import key_names, value_names
from tallybridge.operators.schema import Layout

SAMPLE_ROWS = 10
SAMPLE_COLUMNS = 10
# Columns whose samples one row of the aggregate keeps. A task falls back to sorting when it
# holds more than 128 such rows, which is beyond 4,000 columns.
COLUMNS_A_ROW = 32


def mismatch_samples(
    matched: DataFrame, layout: Layout, rules: dict[str, Comparison], n: int = SAMPLE_ROWS
) -> DataFrame:
    """Up to ``n`` rows per differing column: its keys and both values as text.

    A mergeable aggregate keeps the first ``n`` mismatches of every column: a task holds
    and sends no more than those, and no mismatch is sorted. Rows without one stay out.
    """
    shown = listed(f"top.{k} AS {ident(name)}" for k, name in zip(key_names(layout), layout.keys))
    width = max(1, min(COLUMNS_A_ROW, len(layout.compared)))
    place = listed([*key_names(layout), "_ord"])
    slots = listed(f"v{i}" for i in range(width))
    dealt = query(
        f"""
        SELECT * FROM (SELECT {place}, {_dealt(layout, rules, width)} FROM {{matched}})
        WHERE coalesce({slots}) IS NOT NULL
        """,
        matched=matched,
    )
    # ``reverse`` keeps the least values, in ascending order.
    first = [
        InternalFunction.collect_top_k(expr(f"IF(v{i} IS NULL, NULL, struct({place}, v{i} AS d))"), int(n), True)
        for i in range(width)
    ]
    kept = dealt.groupBy("g").agg(*[top.alias(f"t{i}") for i, top in enumerate(first)])
    return query(
        f"""
        SELECT {texts(layout.compared)}[g * {width} + slot] AS `column`, rank + 1 AS rank,
               {shown}, top.d.original AS value_original, top.d.new AS value_new
        FROM (SELECT g, slot, posexplode(tops) AS (rank, top)
              FROM (SELECT g, posexplode(array({listed(f"t{i}" for i in range(width))})) AS (slot, tops)
                    FROM {{kept}}))
        """,
        kept=kept,
    )


def _dealt(layout: Layout, rules: dict[str, Comparison], width: int) -> str:
    """The select list that deals a row's differing values to rows of ``width`` columns."""
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    none = "CAST(NULL AS STRUCT<original: STRING, new: STRING>)"
    fields = [
        f"""IF({rules[name].match}, {none}, named_struct(
            'original', {as_text(names_s[name], layout.source[name])},
            'new', {as_text(names_t[name], layout.target[name])}))"""
        for name in layout.compared
    ]
    fields += [none] * (-len(fields) % width or (0 if fields else width))
    rows = []
    for begin in range(0, len(fields), width):
        values = [f"'v{i}', {value}" for i, value in enumerate(fields[begin : begin + width])]
        rows.append(f"named_struct({listed([f"'g', {begin // width}", *values])})")
    return f"inline(array({listed(rows)}))"
