"""The same results in plain SQL, for DuckDB over the same tables."""

from __future__ import annotations

from checks.pairs import (
    COPIES,
    DECIMALS,
    HOT_KEYS,
    INCOMPARABLE,
    LINES,
    NULL_KEYS,
    ONE_SIDED_PAIR,
    ORDERS,
    REPEATED_TEXTS,
    SAME,
    TEXTS,
    TYPES,
    UNEQUAL,
    VECTORS,
    WHOLE_EVENTS,
    WHOLE_LINES,
    WIDE,
    WIDE_COLUMNS,
    Pair,
    plain,
)
from checks.queries import JOB_LOG, SQL_FRAGMENTS


def near(a: str, b: str) -> str:
    return f"({a} IS NOT DISTINCT FROM {b} OR coalesce(abs({a} - {b}) <= 0.0001, false))"


def same(a: str, b: str) -> str:
    return f"({a} IS NOT DISTINCT FROM {b})"


# One value of each compared column, and how it is compared.
ORDER_RULES = {
    "cust_id": same,
    "status": same,
    "total": near,
    "order_date": same,
}
LINE_RULES = {
    "l_partkey": same,
    "l_suppkey": same,
    "l_quantity": near,
    "l_extendedprice": near,
}
SUPPLIER_RULES = {"s_name": same, "s_nationkey": same, "s_acctbal": near}
WHOLE_LINE_RULES = {
    "l_partkey": same,
    "l_suppkey": same,
    "l_linenumber": near,
    "l_quantity": near,
    "l_extendedprice": near,
    "l_discount": near,
    "l_tax": near,
    "l_returnflag": same,
    "l_linestatus": same,
    "l_shipdate": same,
}
WIDE_RULES = {f"c{i}": near for i in range(WIDE_COLUMNS)}
WHOLE_EVENT_RULES = {"event_id": same, "ts": same, "user_id": same, "value": near, "props": same}
REPEATED_TEXT_RULES = {"text": same, "source": same, "n_chars": same, "doc_id": same}
NUMERIC = {f"c{i}" for i in range(WIDE_COLUMNS)} | {"value"} | {"wide", "whole", "l_linenumber", "l_discount", "l_tax", "doc_id"} | {"cust_id", "total", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "n_chars"}


def joined(pair: Pair, select: str, how: str = "FULL", where: str = "") -> str:
    """Sides with unique keys, matched null-safely."""
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in pair.keys)
    return f"""{pair.ctes()}, s AS (SELECT *, 1 AS here FROM source),
t AS (SELECT *, 1 AS here FROM target)
SELECT {select} FROM s {how} JOIN t ON {on} {where}"""


def numbered(pair: Pair, order: list[str]) -> str:
    """Common table expressions with the ordinal on both sides."""
    keys, by = ", ".join(pair.keys), ", ".join(f"{c} NULLS FIRST" for c in order)
    ordinal = f"row_number() OVER (PARTITION BY {keys} ORDER BY {by}) AS ordinal"
    return f"""{pair.ctes()}, s AS (SELECT *, {ordinal}, 1 AS here FROM source),
t AS (SELECT *, {ordinal}, 1 AS here FROM target)"""


def verdict(pair: Pair, rules: dict) -> str:
    """Identical: the same column names, and no row that lacks its equal."""
    equal = " AND ".join(rule(f"s.{c}", f"t.{c}") for c, rule in rules.items()) or "true"
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in pair.keys)
    names = "(SELECT list_sort(list(column_name)) FROM (DESCRIBE {}))"
    return f"""SELECT {names.format(plain(pair.source))} = {names.format(plain(pair.target))}
AND NOT EXISTS ({pair.ctes()}, s AS (SELECT *, 1 AS here FROM source), t AS (SELECT *, 1 AS here FROM target)
SELECT 1 FROM s FULL JOIN t ON {on} WHERE s.here IS NULL OR t.here IS NULL OR NOT ({equal})) AS identical"""


def paired(pair: Pair, order: list[str], select: str, how: str = "FULL", where: str = "") -> str:
    """Sides with duplicate keys, matched on key and ordinal."""
    on = " AND ".join(f"s.{k} IS NOT DISTINCT FROM t.{k}" for k in [*pair.keys, "ordinal"])
    return f"{numbered(pair, order)} SELECT {select} FROM s {how} JOIN t ON {on} {where}"


def wide(pair: Pair, rules: dict, source_extra: str = "", target_extra: str = "") -> str:
    columns = [f"s.{k} AS {k}" for k in pair.keys]
    columns += [f"s.{c} AS {c}_original, t.{c} AS {c}_new" for c in rules]
    columns += [f"{rule(f's.{c}', f't.{c}')} AS {c}_match" for c, rule in rules.items()]
    columns += [extra for extra in (source_extra, target_extra) if extra]
    return ", ".join(columns)


def status(pair: Pair, ordinal: str) -> str:
    keys = ", ".join(f"coalesce(s.{k}, t.{k}) AS {k}" for k in pair.keys)
    return f"""{keys}, {ordinal} AS ordinal,
CASE WHEN s.here IS NULL THEN 'target_only' WHEN t.here IS NULL THEN 'source_only'
ELSE 'matched' END AS status"""


def stats(pair: Pair, rules: dict, base: str) -> str:
    """Column statistics over ``base``, a join of ``s`` and ``t`` ending in FROM."""
    head, tail = base.split("SELECT * FROM s", 1)
    measures = ["count(*) AS total"]
    for c, rule in rules.items():
        measures.append(f"count(*) FILTER ({rule(f's.{c}', f't.{c}')}) AS m_{c}")
        measures.append(f"count(*) FILTER ((s.{c} IS NULL) <> (t.{c} IS NULL)) AS n_{c}")
        if c in NUMERIC:
            measures.append(f"CAST(max(abs(s.{c} - t.{c})) AS DOUBLE) AS d_{c}")
    rows = []
    for i, c in enumerate([*pair.keys, *rules]):
        m = f"m_{c}" if c in rules else "total"
        n = f"n_{c}" if c in rules else "0"
        d = f"d_{c}" if c in rules and c in NUMERIC else "0.0"
        rows.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", {m} AS matches, "
            f"total - {m} AS unequal, total, {percent(m)} AS percent, "
            f"CAST({d} AS DOUBLE) AS max_diff, CAST({n} AS BIGINT) AS null_diff FROM measured"
        )
    return (
        f"{head}, measured AS (SELECT {', '.join(measures)} FROM s{tail}) "
        + " UNION ALL ".join(rows)
    )


def percent(part: str, whole: str = "total") -> str:
    return f"round_even(CAST(100 AS DOUBLE) * {part} / nullif({whole}, 0), 2)"


LINE_ORDER = list(LINE_RULES)
ORDER_STATS = stats(ORDERS, ORDER_RULES, joined(ORDERS, "*", "INNER"))
ALL_EQUAL = " AND ".join(rule(f"s.{c}", f"t.{c}") for c, rule in ORDER_RULES.items())
COUNTS = """count(s.here) AS source_rows, count(t.here) AS target_rows,
count(*) FILTER (t.here IS NULL) AS source_only, count(*) FILTER (s.here IS NULL) AS target_only,
count(*) FILTER (s.here = 1 AND t.here = 1) AS matched"""
SUMMARY = f"""{COUNTS}, count(*) FILTER (s.here = 1 AND t.here = 1 AND {ALL_EQUAL}) AS all_equal,
count(*) FILTER (s.here = 1 AND t.here = 1 AND NOT ({ALL_EQUAL})) AS some_unequal"""
ORDER_SUMMARY = joined(ORDERS, SUMMARY)
ORDER_WIDE = joined(
    ORDERS, wide(ORDERS, ORDER_RULES, "s.priority AS priority", "t.channel AS channel"), "INNER"
)

EVENT_RULES = {"ts": same, "event_id": same, "user_id": same, "value": near}
EVENT_ORDER = ["ts", "event_id", "user_id", "value"]
COPY_RULES = {"flag": same, "part": same}
COPY_ORDER = ["flag", "part"]

TYPE_PAIRS = {
    "id": ("bigint", "bigint", "true"),
    "bal": ("double", "string", f"coalesce(abs(s.bal - TRY_CAST(t.bal AS DOUBLE)) <= 0.0001, false)"),
    "nation": ("int", "double", near("s.nation", "t.nation")),
    "seg": ("string", "string", same("s.seg", "t.seg")),
    "flag": ("boolean", "int", "CAST(s.flag AS INT) = t.flag"),
    "ts": ("timestamp", "string", "coalesce(CAST(s.ts AS TIMESTAMP) = TRY_CAST(t.ts AS TIMESTAMP), false)"),
}


def type_pairs() -> str:
    measures = ", ".join(
        f"count(*) FILTER (NOT ({match})) AS u_{c}" for c, (_, _, match) in TYPE_PAIRS.items()
    )
    head, tail = joined(TYPES, "*", "INNER").split("SELECT * FROM s", 1)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{a}' AS source_type, '{b}' AS target_type, "
        f"total, u_{c} AS unequal FROM measured"
        for c, (a, b, _) in TYPE_PAIRS.items()
    )
    return f"{head}, measured AS (SELECT count(*) AS total, {measures} FROM s{tail}) {rows}"


def filled(columns: list[str], sides: list[str]) -> str:
    rows = [
        f"SELECT '{c}' AS \"column\", "
        + ", ".join(f"(SELECT count({c}) FROM {side}) AS {side}_filled" for side in sides)
        for c in columns
    ]
    return f"{ORDERS.ctes()} " + " UNION ALL ".join(rows)


def mismatch_samples() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", order_id, CAST(s_{c} AS VARCHAR) AS value_original,
        CAST(t_{c} AS VARCHAR) AS value_new FROM both_sides WHERE NOT {rule(f's_{c}', f't_{c}')}"""
        for c, rule in ORDER_RULES.items()
    )
    pairs = ", ".join(f"s.{c} AS s_{c}, t.{c} AS t_{c}" for c in ORDER_RULES)
    head, tail = joined(ORDERS, "*", "INNER").split("SELECT * FROM s", 1)
    return f"""{head}, both_sides AS (SELECT s.order_id AS order_id, {pairs} FROM s{tail}),
    found AS ({rows}),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY order_id) AS INT)
               AS rank FROM found)
    SELECT * FROM ranked WHERE rank <= 10"""


ONE_SIDED = f"""{ORDERS.ctes()}
SELECT * FROM (
  SELECT order_id, cust_id, status, total, order_date, priority, NULL AS channel,
         'source' AS side FROM source
  WHERE order_id NOT IN (SELECT order_id FROM target) ORDER BY order_id LIMIT 10) AS a
UNION ALL
SELECT * FROM (
  SELECT order_id, cust_id, status, total, order_date, NULL AS priority, channel,
         'target' AS side FROM target
  WHERE order_id NOT IN (SELECT order_id FROM source) ORDER BY order_id LIMIT 10) AS b"""

SHARED_NAMES = "order_id,cust_id,status,total,order_date"
SUMMARY_DOCUMENT = f"""SELECT 'original' AS nombre_df1, 'new' AS nombre_df2,
source_rows AS total_filas_df1, target_rows AS total_filas_df2,
source_only AS filas_unicas_df1, target_only AS filas_unicas_df2,
matched AS filas_intersectadas, '{SHARED_NAMES}' AS columnas_compartidas,
'priority' AS columnas_unicas_df1, 'channel' AS columnas_unicas_df2,
false AS dataframes_identicos, CAST(0.0001 AS DOUBLE) AS tolerancia_absoluta,
CAST(0 AS DOUBLE) AS tolerancia_relativa FROM ({ORDER_SUMMARY}) AS x"""


def report_overview() -> str:
    lines = {
        1: [
            "'1. INFORMACIÓN GENERAL'",
            "'- DataFrame 1 (Original): original'",
            "'- DataFrame 2 (Nuevo): new'",
            "concat('- Total de filas en DataFrame 1: ', source_rows)",
            "concat('- Total de filas en DataFrame 2: ', target_rows)",
            "concat('- ¿Son DataFrames idénticos? ', CASE WHEN source_only = 0 AND target_only = 0 "
            "AND some_unequal = 0 AND false THEN 'True' ELSE 'False' END)",
        ],
        2: [
            "'2. ANÁLISIS DE COLUMNAS'",
            "'Columnas compartidas:'",
            *[f"'  - {c}'" for c in SHARED_NAMES.split(",")],
            "'Columnas únicas en DataFrame 1:'",
            "'  - priority'",
            "'Columnas únicas en DataFrame 2:'",
            "'  - channel'",
        ],
        3: [
            "'3. ANÁLISIS DE FILAS'",
            "concat('Filas únicas en DataFrame 1: ', source_only)",
            "concat('Filas únicas en DataFrame 2: ', target_only)",
        ],
    }
    return " UNION ALL ".join(
        f"SELECT {section} AS section, {i} AS line_no, {text} AS text FROM ({ORDER_SUMMARY}) AS x"
        for section, texts in lines.items()
        for i, text in enumerate(texts)
    )


def report_differences() -> str:
    columns = f"""SELECT count(*) FILTER (unequal > 0) AS n_some, count(*) FILTER (unequal = 0) AS n_all,
        CAST(sum(unequal) AS BIGINT) AS n_values FROM ({ORDER_STATS}) AS y"""
    lines = [
        (4, 0, "'4. FILAS INTERSECTADAS'"),
        (4, 1, "concat('Total de filas intersectadas: ', matched)"),
        (4, 2, "'Muestra de filas intersectadas (primeras 10):'"),
        (5, 0, "'5. DETALLES DE DISCREPANCIAS'"),
        (5, 1, "'matched on: order_id'"),
        (5, 2, "concat('matched rows with every value equal: ', all_equal)"),
        (5, 3, "concat('matched rows with some value unequal: ', some_unequal)"),
        (5, 4, "'duplicate keys: False'"),
        (5, 5, "'tolerance: absolute 0.0001, relative 0.0'"),
        (5, 500, "concat('columns with some values unequal: ', n_some)"),
        (5, 501, "concat('columns with all values equal: ', n_all)"),
        (5, 502, "concat('values unequal in total: ', n_values)"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT {section} AS section, {i} AS line_no, {text} AS text FROM x, z" for section, i, text in lines
    )
    return f"WITH x AS (SELECT * FROM ({ORDER_SUMMARY}) AS o), z AS ({columns}) {rows}"


LATEST = f"""WITH log AS ({plain(JOB_LOG)}), ranked AS (
SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, seq DESC) AS r FROM log),
latest AS (SELECT job_id, status, progress, result_path, error, updated_at, seq
           FROM ranked WHERE r = 1)"""

ORACLES: dict[str, str] = {
    "q01_spec_sql": plain(" ".join(SQL_FRAGMENTS)),
    "q02_spec_project_alias_filter": """SELECT c_custkey AS id, c_name AS nombre,
        c_acctbal AS saldo, upper(c_mktsegment) AS segmento FROM customer
        WHERE c_acctbal > 0 AND (c_nationkey < 5 OR c_nationkey > 20)""",
    "q03_text_scan": "SELECT * FROM supplier",
    "q03_text_scan_schema": "SELECT * FROM orders",
    "q03_text_round_trip_documents": "SELECT * FROM documents",
    "q03_text_round_trip_conversations": "SELECT * FROM conversations",
    "q04_parquet_land": "SELECT * FROM part",
    "q06_location_fallback": "SELECT * FROM orders",
    "q08_columns_shared": filled(SHARED_NAMES.split(","), ["source", "target"]),
    "q09_columns_source_only": filled(["priority"], ["source"]),
    "q10_columns_target_only": filled(["channel"], ["target"]),
    "q11_type_pairs": type_pairs(),
    "q12_duplicate_keys": """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
        GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
    "q13_key_ordinal": f"{numbered(LINES, LINE_ORDER)} SELECT * EXCLUDE (here) FROM s",
    "q13_key_ordinal_hot": f"{numbered(HOT_KEYS, EVENT_ORDER)} SELECT * EXCLUDE (here) FROM s",
    "q14_row_status": joined(ORDERS, status(ORDERS, "CAST(1 AS BIGINT)")),
    "q14_row_counts": joined(ORDERS, COUNTS),
    "q15_source_only": f"""{ORDERS.ctes()} SELECT * FROM source
        WHERE order_id NOT IN (SELECT order_id FROM target)""",
    "q16_target_only": f"""{ORDERS.ctes()} SELECT * FROM target
        WHERE order_id NOT IN (SELECT order_id FROM source)""",
    "q17_matched_wide": ORDER_WIDE,
    "q18_duplicate_pairing": paired(LINES, LINE_ORDER, wide(LINES, LINE_RULES), "INNER"),
    "q18_duplicate_stats": stats(LINES, LINE_RULES, paired(LINES, LINE_ORDER, "*", "INNER")),
    "q18_duplicate_surplus": paired(
        LINES, LINE_ORDER, "s.* EXCLUDE (ordinal, here)", "LEFT", "WHERE t.here IS NULL"
    ),
    "q19_tolerance": joined(
        ORDERS,
        f"""s.order_id AS order_id, s.total AS total_original, t.total AS total_new,
        {near('s.total', 't.total')} AS total_match""",
        "INNER",
    ),
    "q20_null_equality": joined(
        ORDERS,
        f"""s.order_id AS order_id, s.status AS status_original, t.status AS status_new,
        {same('s.status', 't.status')} AS status_match""",
        "INNER",
    ),
    "q21_mixed_types": joined(
        TYPES,
        "s.id AS id, "
        + ", ".join(f"{m} AS {c}_match" for c, (_, _, m) in TYPE_PAIRS.items() if c != "id"),
        "INNER",
    ),
    "q22_incomparable": stats(
        INCOMPARABLE,
        {"seg": same, "ts": lambda a, b: f"({a} IS NULL AND {b} IS NULL)"},
        joined(INCOMPARABLE, "*", "INNER"),
    ),
    "q23_null_keys": paired(
        NULL_KEYS, ["name", "bal"], status(NULL_KEYS, "coalesce(s.ordinal, t.ordinal)")
    ),
    "q24_nested_values": joined(
        VECTORS,
        f"""s.vec_id AS vec_id, {same('s.embedding', 't.embedding')} AS embedding_match,
        {same('s.label', 't.label')} AS label_match""",
        "INNER",
    ).replace("reverse(", "list_reverse("),
    "q24_long_texts": stats(
        TEXTS, {"text": same, "lang": same, "n_chars": same}, joined(TEXTS, "*", "INNER")
    ),
    "q25_column_stats": ORDER_STATS,
    "q26_row_summary": ORDER_SUMMARY,
    "q27_column_summary": f"""SELECT count(*) FILTER (unequal > 0) AS columns_some_unequal,
        count(*) FILTER (unequal = 0) AS columns_all_equal,
        CAST(sum(unequal) AS BIGINT) AS unequal_values FROM ({ORDER_STATS}) AS x""",
    "q28_verdict": verdict(ORDERS, ORDER_RULES),
    "q28_verdict_same": verdict(SAME, SUPPLIER_RULES),
    "q28_verdict_unequal": verdict(UNEQUAL, SUPPLIER_RULES),
    "q28_verdict_one_sided": verdict(ONE_SIDED_PAIR, SUPPLIER_RULES),
    "q19_wide_decimals": stats(
        DECIMALS, {"wide": near, "whole": near}, paired(DECIMALS, ["wide", "whole"], "*", "INNER")
    ),
    "q37_whole_lines_stats": stats(
        WHOLE_LINES, WHOLE_LINE_RULES, paired(WHOLE_LINES, list(WHOLE_LINE_RULES), "*", "INNER")
    ),
    "q37_repeated_texts_stats": stats(
        REPEATED_TEXTS, REPEATED_TEXT_RULES,
        paired(REPEATED_TEXTS, list(REPEATED_TEXT_RULES), "*", "INNER"),
    ),
    "q29_matched_sample": f"SELECT * FROM ({ORDER_WIDE}) AS x ORDER BY order_id LIMIT 10",
    "q30_mismatch_samples": mismatch_samples(),
    "q31_one_sided_samples": ONE_SIDED,
    "q32_summary_document": SUMMARY_DOCUMENT,
    "q32_report_overview": report_overview(),
    "q33_job_latest_state": f"{LATEST} SELECT * FROM latest",
    "q34_job_result_kind": f"""{LATEST} SELECT job_id,
        CASE WHEN result_path LIKE '%.parquet' THEN 'parquet'
             WHEN result_path LIKE '%.json' THEN 'json'
             WHEN error <> '' THEN 'error' ELSE 'empty' END AS kind FROM latest""",
    "q34_job_status": f"""{LATEST} SELECT c_custkey AS job_id,
        coalesce(status, 'not_found') AS status, coalesce(progress, 0.0) AS progress
        FROM customer LEFT JOIN latest ON job_id = c_custkey""",
    "q35_run_records": f"""SELECT 'finished' AS state, "column" AS columna, matches, total, percent
        FROM ({ORDER_STATS}) AS x""",
    "q36_hot_key_pairing": paired(HOT_KEYS, EVENT_ORDER, wide(HOT_KEYS, EVENT_RULES), "INNER"),
    "q36_hot_key_status": paired(
        HOT_KEYS, EVENT_ORDER, status(HOT_KEYS, "coalesce(s.ordinal, t.ordinal)")
    ),
    "q37_hot_copies_status": paired(
        COPIES, COPY_ORDER, status(COPIES, "coalesce(s.ordinal, t.ordinal)")
    ),
    "q37_hot_copies_pairing": paired(COPIES, COPY_ORDER, wide(COPIES, COPY_RULES), "INNER"),
    "q38_extract_and_compare": ORDER_SUMMARY,
    "q39_published_dataset": "SELECT * FROM lineitem",
    "q39_published_once": "SELECT * FROM documents",
    "q14_key_counts_lines": paired(LINES, LINE_ORDER, COUNTS),
    "q14_key_counts_null_keys": paired(NULL_KEYS, ["name", "bal"], COUNTS),
    "q14_key_counts_hot_copies": paired(COPIES, COPY_ORDER, COUNTS),
    "q25_wide_column_stats": stats(WIDE, WIDE_RULES, joined(WIDE, "*", "INNER")),
    "q25_wide_stats_while_storing": stats(WIDE, WIDE_RULES, joined(WIDE, "*", "INNER")),
    "q36_whole_events_pairing": paired(
        WHOLE_EVENTS, list(WHOLE_EVENT_RULES), wide(WHOLE_EVENTS, WHOLE_EVENT_RULES), "INNER"
    ),
    "q32_report_differences": report_differences(),
}
