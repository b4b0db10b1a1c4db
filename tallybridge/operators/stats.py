"""Counts, per-column statistics and the verdict, each from one pass.

All measures are plain aggregates over the classified relation, so partial
aggregation reduces every task's share to a row, or a row per column, before
anything is shuffled. Where the relation is written anyway they are observed
on the way.
"""

from __future__ import annotations

from collections.abc import Sequence

from tallybridge.functions.comparators import (
    MISSING,
    Comparison,
    Tolerance,
    compare,
    nan_to_null,
)
from tallybridge.functions.sqltext import both, listed, text
from tallybridge.operators.keys import SOURCE, TARGET
from tallybridge.operators.match import value_names
from tallybridge.operators.schema import Layout

MATCHED = "_in_s IS NOT NULL AND _in_t IS NOT NULL"
STATUS = f"""CASE WHEN {MATCHED} THEN 'matched'
WHEN _in_s IS NOT NULL THEN 'source_only' ELSE 'target_only' END"""

ROW_FIELDS = (
    "source_rows",
    "target_rows",
    "source_only",
    "target_only",
    "matched",
    "all_equal",
    "some_unequal",
)
STAT_FIELDS = (
    "position",
    "column",
    "source_type",
    "target_type",
    "matches",
    "unequal",
    "total",
    "percent",
    "max_diff",
    "null_diff",
)


# Columns that are measured by one row of an aggregate.
COLUMNS_A_ROW = 32
# What ``measured_columns`` knows of each column.
STAT_TYPES = (
    "position int, `column` string, source_type string, target_type string, "
    "matches long, null_diff long, max_diff double"
)


def comparisons(layout: Layout, tolerance: Tolerance) -> dict[str, Comparison]:
    """The rule for every compared column, over classified rows."""
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    return {
        name: compare(
            names_s[name], names_t[name], layout.source[name], layout.target[name], tolerance
        )
        for name in layout.compared
    }


def row_measures(rules: dict[str, Comparison]) -> list[str]:
    equal = both(rule.match for rule in rules.values())
    conditions = (
        "_in_s IS NOT NULL",
        "_in_t IS NOT NULL",
        "_in_t IS NULL",
        "_in_s IS NULL",
        MATCHED,
        f"{MATCHED} AND {equal}",
        f"{MATCHED} AND NOT ({equal})",
    )
    return [f"count_if({c}) AS {name}" for name, c in zip(ROW_FIELDS, conditions)]


def column_measures(
    layout: Layout,
    rules: dict[str, Comparison],
    columns: Sequence[str],
    among: str = "true",
) -> list[str]:
    """Three measures per column, numbered as in ``columns``.

    ``among`` restricts them to matched rows where the input has others too.
    """
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    measures = []
    for i, name in enumerate(columns):
        rule = rules[name]
        a = nan_to_null(names_s[name], layout.source[name])
        b = nan_to_null(names_t[name], layout.target[name])
        measures.append(f"count_if({among} AND {rule.match}) AS m{i}")
        measures.append(f"count_if({among} AND ({a} IS NULL) != ({b} IS NULL)) AS n{i}")
        if rule.difference is not None:
            # A missing value already makes the difference NULL; inf - inf does not.
            measures.append(f"max(nanvl({rule.difference}, {MISSING})) AS d{i}")
    return measures


def measured_columns(
    layout: Layout, rules: dict[str, Comparison], measures: dict[str, object]
) -> list[tuple]:
    """Rows of ``STAT_TYPES`` from one row of measures."""
    positions = {name: i for i, name in enumerate(layout.compared)}
    rows = []
    for position, name in enumerate(layout.shared):
        types = layout.source[name].simpleString(), layout.target[name].simpleString()
        i = positions.get(name)
        matches = measures["matched"] if i is None else measures[f"m{i}"]
        gaps = 0 if i is None else measures[f"n{i}"]
        subtracted = i is not None and rules[name].difference is not None
        rows.append((position, name, *types, matches, gaps, measures[f"d{i}"] if subtracted else 0.0))
    return rows


def grouped_columns(layout: Layout, rules: dict[str, Comparison]) -> str:
    """The select list that deals a matched row's shared columns to rows of ``COLUMNS_A_ROW``.

    Aggregated by ``g`` this is one pass however many columns there are, in generated code
    of a size that does not depend on them.
    """
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    fields = []
    for name in layout.shared:
        match, gap, largest = "true", "false", "0.0D"
        if name in rules:
            rule = rules[name]
            a = nan_to_null(names_s[name], layout.source[name])
            b = nan_to_null(names_t[name], layout.target[name])
            match, gap = rule.match, f"({a} IS NULL) != ({b} IS NULL)"
            if rule.difference is not None:
                # A missing value already makes the difference NULL; inf - inf does not.
                largest = f"nanvl({rule.difference}, {MISSING})"
        fields.append((match, gap, largest))
    width = min(COLUMNS_A_ROW, len(fields))
    fields += [("false", "false", "CAST(NULL AS DOUBLE)")] * (-len(fields) % width)
    rows = []
    for begin in range(0, len(fields), width):
        values = [f"'g', {begin // width}"]
        for i, field in enumerate(fields[begin : begin + width]):
            values += [f"'{kind}{i}', {value}" for kind, value in zip("mnd", field)]
        rows.append(f"named_struct({listed(values)})")
    return f"inline(array({listed(rows)}))"


def grouped_measures(layout: Layout) -> list[str]:
    """Measures of one such row, as a list for every measure."""
    width = range(min(COLUMNS_A_ROW, len(layout.shared)))
    return [
        "count(*) AS total",
        f"array({listed(f'count_if(m{i})' for i in width)}) AS matches",
        f"array({listed(f'count_if(n{i})' for i in width)}) AS gaps",
        f"array({listed(f'max(d{i})' for i in width)}) AS largest",
    ]


def column_list(layout: Layout, rules: dict[str, Comparison]) -> str:
    """The select list of the shared columns: types, the row and slot of their measures.

    ``none`` is the largest difference of no rows.
    """
    rows = []
    width = min(COLUMNS_A_ROW, len(layout.shared))
    for position, name in enumerate(layout.shared):
        subtracted = name in rules and rules[name].difference is not None
        values = (
            str(position),
            text(name),
            text(layout.source[name].simpleString()),
            text(layout.target[name].simpleString()),
            "CAST(NULL AS DOUBLE)" if subtracted else "0.0D",
            str(position // width),
            str(position % width),
        )
        names = (*STAT_FIELDS[:4], "none", "g", "slot")
        rows.append("named_struct(" + listed(f"'{f}', {v}" for f, v in zip(names, values)) + ")")
    return f"inline(array({listed(rows)}))"


def percent(part: str, whole: str) -> str:
    """Two places, ties to even; NULL when there is nothing to divide by."""
    return f"bround(100.0D * {part} / nullif({whole}, 0), 2)"


def verdict(layout: Layout) -> str:
    """Identical: same columns, no one-sided rows, every matched row equal."""
    same = "true" if layout.same_columns else "false"
    return f"({same} AND source_only = 0 AND target_only = 0 AND some_unequal = 0)"
