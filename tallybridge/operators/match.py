"""Row matching: a full outer join on composite keys, duplicates paired by ordinal.

The classified relation has the key columns ``_k0..``, the pairing ordinal
``_ord``, the source's other columns ``_s0..``, the target's ``_t0..`` and the
presence markers ``_in_s`` and ``_in_t``. Presence is decided by the markers,
because a NULL key is a legal key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

from tallybridge.functions.nested import sql_type
from tallybridge.functions.sqltext import both, ident, listed, query
from tallybridge.operators.keys import (
    HOT_KEY_ROWS,
    ROWS_PER_RANGE,
    SOURCE,
    TARGET,
    KeyProfile,
    number_hot,
    number_ordinary,
    ordering,
    profile_keys,
    split_hot,
    spread,
)
from tallybridge.operators.schema import Layout, key_value
from tallybridge.workspace import Workspace

# Types whose equal values are the same value.
_EXACT = (
    T.IntegralType,
    T.DecimalType,
    T.BooleanType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.BinaryType,
)


def key_names(layout: Layout) -> list[str]:
    return [f"_k{i}" for i in range(len(layout.keys))]


def value_names(layout: Layout, side: int) -> dict[str, str]:
    """Internal name of every non-key column of one side."""
    columns, prefix = (layout.source, "_s") if side == SOURCE else (layout.target, "_t")
    values = [name for name in columns if name not in layout.keys]
    return {name: f"{prefix}{i}" for i, name in enumerate(values)}


def _keys_of(layout: Layout, side: int) -> list[str]:
    given = layout.source if side == SOURCE else layout.target
    return [
        f"{key_value(name, dtype, given[name])} AS {inner}"
        for name, dtype, inner in zip(layout.keys, layout.key_types, key_names(layout))
    ]


def _values_of(layout: Layout, side: int) -> list[str]:
    return [f"{ident(name)} AS {inner}" for name, inner in value_names(layout, side).items()]


def _same_keys(layout: Layout) -> str:
    return both(f"l.{k} <=> r.{k}" for k in key_names(layout))


def profile(
    source: DataFrame, target: DataFrame, layout: Layout, hot_key_rows: int = HOT_KEY_ROWS
) -> KeyProfile:
    keys = query(
        f"""
        SELECT {SOURCE} AS _side, {listed(_keys_of(layout, SOURCE))} FROM {{source}}
        UNION ALL
        SELECT {TARGET} AS _side, {listed(_keys_of(layout, TARGET))} FROM {{target}}
        """,
        source=source,
        target=target,
    )
    return profile_keys(keys, key_names(layout), hot_key_rows)


def row_counts(source: DataFrame, target: DataFrame, layout: Layout) -> DataFrame:
    """Rows per side, one-sided and matched, from how often each side holds each key.

    Copies pair one to one, so a key's pairs are the lesser count and the surplus is what
    the other side lacks, whichever copies those are. Counts combine on the map side: no
    key needs a profile, a sort or a window, however often it repeats.
    """
    keys = listed(key_names(layout))
    return query(
        f"""
        SELECT coalesce(sum(_n0), 0L) AS source_rows, coalesce(sum(_n1), 0L) AS target_rows,
               coalesce(sum(greatest(_n0 - _n1, 0L)), 0L) AS source_only,
               coalesce(sum(greatest(_n1 - _n0, 0L)), 0L) AS target_only,
               coalesce(sum(least(_n0, _n1)), 0L) AS matched
        FROM (SELECT count_if(_side = {SOURCE}) AS _n0, count_if(_side = {TARGET}) AS _n1
              FROM (SELECT {SOURCE} AS _side, {listed(_keys_of(layout, SOURCE))} FROM {{source}}
                    UNION ALL
                    SELECT {TARGET} AS _side, {listed(_keys_of(layout, TARGET))} FROM {{target}})
              GROUP BY {keys})
        """,
        source=source,
        target=target,
    )


def classify_unique(source: DataFrame, target: DataFrame, layout: Layout) -> DataFrame:
    """No key repeats on either side: one null-safe full outer join.

    A filter on the markers lets the optimizer narrow it to an inner or
    one-sided join and prune the columns of the other side.
    """
    left = listed([*_keys_of(layout, SOURCE), *_values_of(layout, SOURCE), "true AS _in_s"])
    right = listed([*_keys_of(layout, TARGET), *_values_of(layout, TARGET), "true AS _in_t"])
    shown = [
        *[f"coalesce(l.{k}, r.{k}) AS {k}" for k in key_names(layout)],
        "1L AS _ord",
        *value_names(layout, SOURCE).values(),
        *value_names(layout, TARGET).values(),
        "_in_s",
        "_in_t",
    ]
    return query(
        f"""
        SELECT {listed(shown)} FROM (SELECT {left} FROM {{source}}) AS l
        FULL JOIN (SELECT {right} FROM {{target}}) AS r ON {_same_keys(layout)}
        """,
        source=source,
        target=target,
    )


def classify_duplicates(
    source: DataFrame,
    target: DataFrame,
    layout: Layout,
    key_profile: KeyProfile,
    workspace: Workspace,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Keys repeat: stack the sides, number the copies, fold equal numbers.

    Stacking means one shuffle on the key serves the numbering and the pairing;
    grouping treats NULL keys as equal by itself. Hot keys are numbered in
    ranges and paired on (key, ordinal), which spreads them evenly.
    """
    keys = key_names(layout)
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    common = _common(layout)
    order = ordering(
        [
            [(common[n], layout.source[n])]
            if n in common
            else [(names_s[n], layout.source[n]), (names_t[n], layout.target[n])]
            for n in layout.compared
        ]
        + [[(names_s[n], layout.source[n])] for n in layout.source_only]
        + [[(names_t[n], layout.target[n])] for n in layout.target_only]
    )
    ordinary, hot = split_hot(_stack(source, target, layout), keys, key_profile)
    numbered = number_ordinary(ordinary, keys, order, key_profile.ordinary_rows)
    classified = _fold(numbered, layout)
    if hot is not None:
        numbered = number_hot(
            hot, keys, layout.key_types, order, workspace, key_profile, rows_per_range
        )
        numbered = spread(numbered, [*keys, "_ord"], key_profile.hot_rows)
        classified = classified.unionByName(_fold(numbered, layout))
    return classified


def _common(layout: Layout) -> dict[str, str]:
    """Compared columns of one type, which both sides keep in the same place."""
    same = [n for n in layout.compared if sql_type(layout.source[n]) == sql_type(layout.target[n])]
    return {name: f"_c{i}" for i, name in enumerate(same)}


def _stack(source: DataFrame, target: DataFrame, layout: Layout) -> DataFrame:
    """Both sides in one relation, no wider than it has to be."""
    common = _common(layout)

    def select(side: int) -> str:
        shown = [f"{ident(name)} AS {place}" for name, place in common.items()]
        for which, types in ((SOURCE, layout.source), (TARGET, layout.target)):
            for name, place in value_names(layout, which).items():
                if name not in common:
                    here = ident(name) if side == which else f"CAST(NULL AS {sql_type(types[name])})"
                    shown.append(f"{here} AS {place}")
        return listed([f"{side} AS _side", *_keys_of(layout, side), *shown])

    return query(
        f"""
        SELECT {select(SOURCE)} FROM {{source}} UNION ALL SELECT {select(TARGET)} FROM {{target}}
        """,
        source=source,
        target=target,
    )


def _fold(numbered: DataFrame, layout: Layout) -> DataFrame:
    """Bring the source row and the target row of one (key, ordinal) together.

    At most one row per side shares a key and an ordinal, so the target row, if
    there is one, directly follows the source row.
    """
    keys, common = listed(key_names(layout)), _common(layout)
    names_t = value_names(layout, TARGET)
    places = {name: common.get(name, inner) for name, inner in names_t.items()}
    nearby = ["lead(_side) OVER w AS _following", "lag(_side) OVER w AS _preceding"]
    nearby += [f"lead({place}) OVER w AS _n{place}" for place in places.values()]
    shown = [
        f"IF(_side = {SOURCE}, {common[name]}, NULL) AS {inner}" if name in common else inner
        for name, inner in value_names(layout, SOURCE).items()
    ]
    shown += [
        f"IF(_side = {TARGET}, {places[name]}, _n{places[name]}) AS {inner}"
        for name, inner in names_t.items()
    ]
    return query(
        f"""
        SELECT {listed([keys, "_ord", *shown])},
               IF(_side = {SOURCE}, true, NULL) AS _in_s,
               IF(_side = {TARGET} OR _following IS NOT NULL, true, NULL) AS _in_t
        FROM (SELECT *, {listed(nearby)}
              FROM {{rows}} WINDOW w AS (PARTITION BY {keys}, _ord ORDER BY _side))
        WHERE _preceding IS NULL
        """,
        rows=numbered,
    )


def _once(layout: Layout) -> dict[str, str]:
    """When the target's value, by its name, is the very value of the source."""
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    conditions = {}
    for name in _common(layout):
        dtype, s, t = layout.source[name], names_s[name], names_t[name]
        if isinstance(dtype, T.FractionalType) and not isinstance(dtype, T.DecimalType):
            # 0.0 equals -0.0.
            conditions[t] = f"{s} <=> {t} AND coalesce({s} != 0, true)"
        elif isinstance(dtype, _EXACT) or dtype == T.StringType():
            conditions[t] = f"{s} <=> {t}"
    return conditions


def kept_once(classified: DataFrame, layout: Layout) -> DataFrame:
    """Classified rows without the target values that are the source's, ``_same_t0..`` flags instead."""
    same = _once(layout)
    shown = [
        f"IF({same[c]}, NULL, {c}) AS {c}" if c in same else c for c in classified.columns
    ]
    shown += [f"({condition}) AS _same{t}" for t, condition in same.items()]
    return query(f"SELECT {listed(shown)} FROM {{rows}}", rows=classified)


def kept_twice(stored: DataFrame, layout: Layout) -> DataFrame:
    """The rows that ``kept_once`` was given."""
    names_s, names_t = value_names(layout, SOURCE), value_names(layout, TARGET)
    source_of = {names_t[name]: names_s[name] for name in _common(layout)}
    same = _once(layout)
    shown = [
        f"IF(_same{c}, {source_of[c]}, {c}) AS {c}" if c in same else c
        for c in stored.columns
        if not c.startswith("_same")
    ]
    return query(f"SELECT {listed(shown)} FROM {{rows}}", rows=stored)


def only_in(source: DataFrame, target: DataFrame, layout: Layout, side: int) -> DataFrame:
    """Rows of one side whose key the other lacks; for keys that never repeat.

    An anti join, so the other side contributes nothing but its keys.
    """
    here, there = (source, target) if side == SOURCE else (target, source)
    types = layout.source if side == SOURCE else layout.target
    other = TARGET if side == SOURCE else SOURCE
    inside = listed(f"{ident(name)} AS _v{i}" for i, name in enumerate(types))
    columns = listed(f"_v{i} AS {ident(name)}" for i, name in enumerate(types))
    return query(
        f"""
        SELECT {columns} FROM (SELECT {listed(_keys_of(layout, side))}, {inside} FROM {{here}}) AS l
        LEFT ANTI JOIN (SELECT {listed(_keys_of(layout, other))} FROM {{there}}) AS r
        ON {_same_keys(layout)}
        """,
        here=here,
        there=there,
    )
