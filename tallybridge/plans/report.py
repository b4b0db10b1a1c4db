"""The summary document and the detailed text report, as small DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from tallybridge.functions.nested import as_text
from tallybridge.functions.sqltext import ident, listed, number, query, text, texts
from tallybridge.operators import samples, stats
from tallybridge.plans.reconcile import Reconciliation

JSON_OPTIONS = "map('ignoreNullFields', 'false')"

# Field names of the summary document, in order.
SUMMARY_FIELDS = ("fecha_generacion", "nombre_df1", "nombre_df2")
METRIC_FIELDS = (
    ("total_filas_df1", "source_rows"),
    ("total_filas_df2", "target_rows"),
    ("filas_unicas_df1", "source_only"),
    ("filas_unicas_df2", "target_only"),
    ("filas_intersectadas", "matched"),
)
STRUCTURE_FIELDS = ("columnas_compartidas", "columnas_unicas_df1", "columnas_unicas_df2")
STATE_FIELDS = ("dataframes_identicos", "tolerancia_absoluta", "tolerancia_relativa")

# Headings and line formats of the detailed report.
REPORT_TITLE = "REPORTE DETALLADO DE COMPARACIÓN DE DATAFRAMES"
DATE_LINE = "Fecha: %s"
SECTION_GENERAL = "1. INFORMACIÓN GENERAL"
NAME_1 = "- DataFrame 1 (Original): %s"
NAME_2 = "- DataFrame 2 (Nuevo): %s"
ROWS_1 = "- Total de filas en DataFrame 1: %d"
ROWS_2 = "- Total de filas en DataFrame 2: %d"
IDENTICAL = "- ¿Son DataFrames idénticos? %s"
SECTION_COLUMNS = "2. ANÁLISIS DE COLUMNAS"
SHARED_COLUMNS = "Columnas compartidas:"
ONLY_COLUMNS_1 = "Columnas únicas en DataFrame 1:"
ONLY_COLUMNS_2 = "Columnas únicas en DataFrame 2:"
COLUMN_LINE = "  - %s"
SECTION_ROWS = "3. ANÁLISIS DE FILAS"
ONLY_ROWS_1 = "Filas únicas en DataFrame 1: %d"
ONLY_ROWS_2 = "Filas únicas en DataFrame 2: %d"
SECTION_MATCHED = "4. FILAS INTERSECTADAS"
MATCHED_ROWS = "Total de filas intersectadas: %d"
MATCHED_SAMPLE = "Muestra de filas intersectadas (primeras 10):"
SECTION_DIFFERENCES = "5. DETALLES DE DISCREPANCIAS"


def summary(rec: Reconciliation) -> DataFrame:
    """One row: counts, column sets, verdict and tolerances."""
    layout = rec.layout
    lists = (layout.shared, layout.source_only, layout.target_only)
    state = (
        stats.verdict(layout),
        number(rec.tolerance.absolute),
        number(rec.tolerance.relative),
    )
    leading = (
        "date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\")",
        text(rec.source_name),
        text(rec.target_name),
    )
    shown = [
        *[f"{value} AS {name}" for name, value in zip(SUMMARY_FIELDS, leading)],
        f"{_record(dict(METRIC_FIELDS))} AS metricas",
        f"{_record(dict(zip(STRUCTURE_FIELDS, map(texts, lists))))} AS estructura",
        f"{_record(dict(zip(STATE_FIELDS, state)))} AS estado_comparacion",
    ]
    return query(f"SELECT {listed(shown)} FROM {{counts}}", counts=rec.row_summary())


def _record(values: Mapping[str, str]) -> str:
    return f"named_struct({listed(f'{text(k)}, {v}' for k, v in values.items())})"


def summary_json(rec: Reconciliation) -> DataFrame:
    return query(
        f"SELECT to_json(struct(*), {JSON_OPTIONS}) AS value FROM {{summary}}",
        summary=summary(rec),
    )


def report(rec: Reconciliation) -> DataFrame:
    """The detailed report as ``(section, line_no, text)``.

    Its length depends on the number of columns, never on the number of rows.
    Pass a stored reconciliation: several parts read the classified rows.
    """
    counts = rec.row_summary()
    parts = [
        _lines(counts, _overview(rec)),
        _sample_lines(rec.matched_sample(), 4, 100),
        _lines(counts, _difference_head(rec), f"WHERE NOT {stats.verdict(rec.layout)}"),
        _difference_summary(rec),
        _difference_columns(rec),
        _mismatch_lines(rec),
        _sample_lines(rec.source_only_sample(), 5, 300_000, "source only: "),
        _sample_lines(rec.target_only_sample(), 5, 400_000, "target only: "),
    ]
    return reduce(DataFrame.unionByName, parts)


def _lines(counts: DataFrame, sections: Mapping[int, Sequence[str]], tail: str = "") -> DataFrame:
    rows = [
        f"named_struct('section', {section}, 'line_no', {i}, 'text', {line})"
        for section, lines in sections.items()
        for i, line in enumerate(lines)
    ]
    return query(f"SELECT inline(array({listed(rows)})) FROM {{counts}} {tail}", counts=counts)


def _filled_in(pattern: str, value: str) -> str:
    return f"format_string({text(pattern)}, {value})"


def _overview(rec: Reconciliation) -> dict[int, list[str]]:
    layout = rec.layout

    def names(columns: Sequence[str]) -> list[str]:
        return [text(COLUMN_LINE % name) for name in columns]

    verdict = f"IF({stats.verdict(layout)}, 'True', 'False')"
    return {
        0: [
            text(REPORT_TITLE),
            _filled_in(DATE_LINE, "CAST(current_timestamp() AS STRING)"),
        ],
        1: [
            text(SECTION_GENERAL),
            text(NAME_1 % rec.source_name),
            text(NAME_2 % rec.target_name),
            _filled_in(ROWS_1, "source_rows"),
            _filled_in(ROWS_2, "target_rows"),
            _filled_in(IDENTICAL, verdict),
        ],
        2: [
            text(SECTION_COLUMNS),
            text(SHARED_COLUMNS),
            *names(layout.shared),
            text(ONLY_COLUMNS_1),
            *names(layout.source_only),
            text(ONLY_COLUMNS_2),
            *names(layout.target_only),
        ],
        3: [
            text(SECTION_ROWS),
            _filled_in(ONLY_ROWS_1, "source_only"),
            _filled_in(ONLY_ROWS_2, "target_only"),
        ],
        4: [
            text(SECTION_MATCHED),
            _filled_in(MATCHED_ROWS, "matched"),
            text(MATCHED_SAMPLE),
        ],
    }


def _sample_lines(sample: DataFrame, section: int, start: int, prefix: str = "") -> DataFrame:
    """At most ten rows, numbered in the order they came out."""
    return query(
        f"""
        SELECT {section} AS section,
               {start} + row_number() OVER (PARTITION BY {section} ORDER BY n) AS line_no,
               text
        FROM (SELECT concat({text(prefix)}, to_json(struct(*), {JSON_OPTIONS})) AS text,
                     monotonically_increasing_id() AS n
              FROM {{sample}})
        """,
        sample=sample,
    )


def _difference_head(rec: Reconciliation) -> dict[int, list[str]]:
    layout, tolerance = rec.layout, rec.tolerance
    return {
        5: [
            text(SECTION_DIFFERENCES),
            text(f"matched on: {', '.join(layout.keys)}"),
            _filled_in("matched rows with every value equal: %d", "all_equal"),
            _filled_in("matched rows with some value unequal: %d", "some_unequal"),
            text(f"duplicate keys: {not rec.key_profile.unique}"),
            text(f"tolerance: absolute {tolerance.absolute}, relative {tolerance.relative}"),
        ]
    }


def _difference_summary(rec: Reconciliation) -> DataFrame:
    """How many columns and values differ; two relations of one row each, folded into one."""
    patterns = (
        ("columns with some values unequal: %d", "columns_some_unequal"),
        ("columns with all values equal: %d", "columns_all_equal"),
        ("values unequal in total: %d", "unequal_values"),
    )
    lines = [
        f"named_struct('section', 5, 'line_no', {500 + i}, 'text', {_filled_in(p, n)})"
        for i, (p, n) in enumerate(patterns)
    ]
    names = [name for _, name in patterns]
    return query(
        f"""
        SELECT inline(array({listed(lines)}))
        FROM (SELECT {listed(f"max({n}) AS {n}" for n in names)}, bool_and(same) AS same
              FROM (SELECT {listed(names)}, CAST(NULL AS BOOLEAN) AS same FROM {{summary}}
                    UNION ALL
                    SELECT {listed("NULL" for _ in names)}, {stats.verdict(rec.layout)} FROM {{counts}}))
        WHERE NOT same
        """,
        summary=rec.column_summary(),
        counts=rec.row_summary(),
    )


def _difference_columns(rec: Reconciliation) -> DataFrame:
    """Columns with unequal values or with different types."""
    pattern = "%s (%s, %s): %d of %d unequal, largest difference %s, one-sided nulls %d"
    return query(
        f"""
        SELECT 5 AS section, 1000 + position AS line_no,
               format_string({text(pattern)}, `column`, source_type, target_type, unequal,
                             total, CAST(max_diff AS STRING), null_diff) AS text
        FROM {{stats}} WHERE unequal > 0 OR source_type != target_type
        """,
        stats=rec.column_stats(),
    )


def _mismatch_lines(rec: Reconciliation) -> DataFrame:
    layout = rec.layout
    shown = listed(
        f"concat({text(k + '=')}, coalesce({as_text(ident(k), t)}, 'NULL'))"
        for k, t in zip(layout.keys, layout.key_types)
    )
    position = f"CAST(array_position({texts(layout.shared)}, `column`) AS INT)"
    return query(
        f"""
        SELECT 5 AS section, 10000 + {position} * {samples.SAMPLE_ROWS + 1} + rank AS line_no,
               concat(`column`, ': ', concat_ws(', ', {shown}), ': ',
                      coalesce(value_original, 'NULL'), ' -> ',
                      coalesce(value_new, 'NULL')) AS text
        FROM {{found}}
        """,
        found=rec.mismatch_samples(),
    )
