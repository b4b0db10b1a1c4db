"""The registered queries, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.pairs import (
    COPIES,
    HOT_KEYS,
    INCOMPARABLE,
    LINES,
    NULL_KEYS,
    DECIMALS,
    ONE_SIDED_PAIR,
    ORDERS,
    REPEATED_TEXTS,
    SAME,
    UNEQUAL,
    WHOLE_EVENTS,
    WHOLE_LINES,
    WIDE,
    TEXTS,
    TYPES,
    VECTORS,
    Pair,
    load,
    table,
)
from tallybridge.operators.keys import duplicate_keys, key_ordinals
from tallybridge.operators.schema import column_presence
from tallybridge.plans.jobs import extract_pair
from tallybridge.plans.reconcile import Reconciliation, count_rows, reconcile
from tallybridge.plans.report import report, summary
from tallybridge.sinks.ledger import (
    FINISHED,
    Ledger,
    latest_state,
    parsed_runs,
    result_document,
    result_kinds,
    run_record,
    status_of,
)
from tallybridge.sinks.tables import publish, publish_rows, read_published, save_csv, save_parquet
from tallybridge.sources.files import inventory, read_parquet, read_text, undoubled
from tallybridge.sources.spec import QUERY, SourceSpec, read_spec
from tallybridge.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]

# Small enough to make the five event types hot, in several ranges, at every test scale.
LOW_HOT_ROWS = 100
LOW_RANGE_ROWS = 20_000


def compared(spark: SparkSession, sf_dir: str, pair: Pair, **options) -> Reconciliation:
    source, target = pair.load(spark, sf_dir)
    return reconcile(source, target, pair.keys, **options)


# -- specs and sources -------------------------------------------------------

SQL_FRAGMENTS = [
    "SELECT o_orderkey, o_custkey, o_totalprice,",
    "concat(o_orderstatus, '  /  ', o_orderpriority) AS tag",
    "FROM {orders}",
    "WHERE o_totalprice > 100000",
]


def spec_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("landed_orders")
    fragments = [text.format(orders="landed_orders") for text in SQL_FRAGMENTS]
    return read_spec(spark, SourceSpec.from_dict({"type": "SQL", "query": fragments}))


def spec_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceGlobalTempView("landed_customer")
    spec = SourceSpec.from_dict(
        {
            "schema": "global_temp",
            "table_name": "landed_customer",
            "columns": ["c_custkey", "c_name", "c_acctbal", "upper(c_mktsegment)"],
            "alias": ["id", "nombre", "saldo", "segmento"],
            "filter": ["c_acctbal > 0", "c_nationkey < 5 OR c_nationkey > 20"],
        }
    )
    return read_spec(spark, spec)


def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark).root}/supplier.csv"
    save_csv(table(spark, sf_dir, "supplier"), path)
    spec = SourceSpec.from_dict({"type": "TXT", "input_path": path})
    return read_spec(spark, spec).withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


def text_scan_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark).root}/orders.csv"
    orders = table(spark, sf_dir, "orders")
    orders.write.option("sep", "|").option("header", False).csv(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema)
    return read_text(spark, path, "|", False, schema)


def text_round_trip(name: str):
    """A whole table with line breaks and quotes, written and read back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{Workspace(spark).root}/{name}.csv"
        df = table(spark, sf_dir, name)
        save_csv(df, path)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
        return undoubled(read_text(spark, path, schema=schema))

    return run


def parquet_land(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark).root}/part.parquet"
    save_parquet(table(spark, sf_dir, "part"), path)
    return read_parquet(spark, path)


def location_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, "/not/landed/here/orders.parquet", roots=["/nor/here", sf_dir])


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Workspace(spark).root
    landed = f"{root}/lines.parquet"
    lines = table(spark, sf_dir, "lineitem")
    # Several parts at every size: those of the input, or four of a table that has fewer.
    if lines.rdd.getNumPartitions() < 4:
        lines = lines.repartition(4, "l_orderkey")
    save_parquet(lines, landed)
    return read_parquet(spark, publish(spark, landed, f"{root}/box", "extract-1"))


def published_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = f"{Workspace(spark).root}/box/extract-2/documents.parquet"
    return read_published(spark, publish_rows(table(spark, sf_dir, "documents"), uri))


def extract_and_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides through specs, landed, then compared on the spec's own key."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("landed_orders")
    sql = {"orders": "landed_orders"}
    source = SourceSpec(kind=QUERY, query=ORDERS.source.format(**sql), key=("ORDER_ID",))
    target = SourceSpec(kind=QUERY, query=ORDERS.target.format(**sql))
    pair = extract_pair(spark, source, target, Workspace(spark).root)
    rec = reconcile(
        read_parquet(spark, pair.source), read_parquet(spark, pair.target), pair.keys
    )
    return rec.row_summary()


# -- schema ------------------------------------------------------------------


def columns_placed(placement: str, *fields: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        presence = column_presence(*ORDERS.load(spark, sf_dir))
        return presence.where(F.col("placement") == placement).select("column", *fields)

    return query


def type_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = compared(spark, sf_dir, TYPES).column_stats()
    return stats.select("column", "source_type", "target_type", "total", "unequal")


# -- matching ----------------------------------------------------------------


def row_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir, ORDERS).row_status()


def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir, ORDERS).row_summary().drop("all_equal", "some_unequal")


def key_counts(pair: Pair) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return count_rows(*pair.load(spark, sf_dir), pair.keys)

    return query


def stored_stats(pair: Pair) -> Query:
    """Measured while the classified rows are written."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = compared(spark, sf_dir, pair).stored().column_stats()
        return stats.drop("source_type", "target_type")

    return query


def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(load(spark, sf_dir, LINES.source), LINES.keys)


def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_ordinals(load(spark, sf_dir, LINES.source), LINES.keys)


def hot_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_ordinals(
        load(spark, sf_dir, HOT_KEYS.source),
        HOT_KEYS.keys,
        hot_key_rows=LOW_HOT_ROWS,
        rows_per_range=LOW_RANGE_ROWS,
    )


def hot_pairing(pair: Pair) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rec = compared(
            spark, sf_dir, pair, hot_key_rows=LOW_HOT_ROWS, rows_per_range=LOW_RANGE_ROWS
        )
        return rec.matched_rows()

    return query


def hot_status(pair: Pair) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rec = compared(
            spark, sf_dir, pair, hot_key_rows=LOW_HOT_ROWS, rows_per_range=LOW_RANGE_ROWS
        )
        return rec.row_status()

    return query


def matched_columns(pair: Pair, *columns: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return compared(spark, sf_dir, pair).matched_rows().select(*columns)

    return query


def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir, NULL_KEYS).row_status()


# -- measures, samples, documents -------------------------------------------


def column_stats(pair: Pair) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stats = compared(spark, sf_dir, pair).column_stats()
        return stats.drop("source_type", "target_type")

    return query


def one_sided_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = compared(spark, sf_dir, ORDERS)
    source = rec.source_only_sample().withColumn("side", F.lit("source"))
    target = rec.target_only_sample().withColumn("side", F.lit("target"))
    return source.unionByName(target, allowMissingColumns=True)


def summary_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    document = summary(compared(spark, sf_dir, ORDERS))
    structure = [
        F.array_join(f"estructura.{name}", ",").alias(name)
        for name in ("columnas_compartidas", "columnas_unicas_df1", "columnas_unicas_df2")
    ]
    return document.select(
        "nombre_df1", "nombre_df2", "metricas.*", *structure, "estado_comparacion.*"
    )


def report_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(compared(spark, sf_dir, ORDERS)).where(F.col("section").between(1, 3))


def report_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of section 4 and the head of section 5."""
    lines = report(compared(spark, sf_dir, ORDERS).stored()).where("section >= 4 AND line_no < 1000 AND NOT text LIKE '{%'")
    return lines.select("section", "line_no", "text")


# -- ledger ------------------------------------------------------------------

JOB_LOG = """
SELECT user_id AS job_id, event_type AS status, value AS progress,
       CASE WHEN event_type = 'purchase' THEN concat('out/', event_id, '.parquet')
            WHEN event_type = 'view' THEN concat('out/', event_id, '.json') END AS result_path,
       CASE WHEN event_type = 'error' THEN props END AS error,
       ts AS updated_at, event_id AS seq
FROM {events}"""


def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_state(load(spark, sf_dir, JOB_LOG))


def job_result_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return result_kinds(load(spark, sf_dir, JOB_LOG))


def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id"))
    return status_of(load(spark, sf_dir, JOB_LOG), asked)


def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Ledger(spark, Workspace(spark).root)
    stats = compared(spark, sf_dir, ORDERS).column_stats()
    ledger.append_run(run_record(result_document(stats), FINISHED))
    return parsed_runs(ledger.runs()).select(
        "state", "columna", "matches", "total", "percent"
    )


QUERIES: dict[str, Query] = {
    "q01_spec_sql": spec_sql,
    "q02_spec_project_alias_filter": spec_project,
    "q03_text_scan": text_scan,
    "q03_text_scan_schema": text_scan_schema,
    "q03_text_round_trip_documents": text_round_trip("documents"),
    "q03_text_round_trip_conversations": text_round_trip("conversations"),
    "q04_parquet_land": parquet_land,
    "q06_location_fallback": location_fallback,
    "q07_inventory": lambda spark, sf_dir: inventory(spark, sf_dir),
    "q08_columns_shared": columns_placed("shared", "source_filled", "target_filled"),
    "q09_columns_source_only": columns_placed("source_only", "source_filled"),
    "q10_columns_target_only": columns_placed("target_only", "target_filled"),
    "q11_type_pairs": type_pairs,
    "q12_duplicate_keys": repeated_keys,
    "q13_key_ordinal": ordinals,
    "q13_key_ordinal_hot": hot_ordinals,
    "q14_row_status": row_status,
    "q14_row_counts": row_counts,
    "q15_source_only": lambda spark, sf: compared(spark, sf, ORDERS).source_only_rows(),
    "q16_target_only": lambda spark, sf: compared(spark, sf, ORDERS).target_only_rows(),
    "q17_matched_wide": lambda spark, sf: compared(spark, sf, ORDERS).matched_rows(),
    "q18_duplicate_pairing": lambda spark, sf: compared(spark, sf, LINES).matched_rows(),
    "q18_duplicate_stats": column_stats(LINES),
    "q18_duplicate_surplus": lambda spark, sf: compared(spark, sf, LINES).source_only_rows(),
    "q19_tolerance": matched_columns(
        ORDERS, "order_id", "total_original", "total_new", "total_match"
    ),
    "q20_null_equality": matched_columns(
        ORDERS, "order_id", "status_original", "status_new", "status_match"
    ),
    "q21_mixed_types": matched_columns(
        TYPES, "id", "bal_match", "nation_match", "seg_match", "flag_match", "ts_match"
    ),
    "q22_incomparable": column_stats(INCOMPARABLE),
    "q23_null_keys": null_keys,
    "q24_nested_values": matched_columns(VECTORS, "vec_id", "embedding_match", "label_match"),
    "q24_long_texts": column_stats(TEXTS),
    "q25_column_stats": column_stats(ORDERS),
    "q26_row_summary": lambda spark, sf: compared(spark, sf, ORDERS).row_summary(),
    "q27_column_summary": lambda spark, sf: compared(spark, sf, ORDERS).column_summary(),
    "q28_verdict": lambda spark, sf: compared(spark, sf, ORDERS).verdict(),
    "q28_verdict_same": lambda spark, sf: compared(spark, sf, SAME).verdict(),
    "q28_verdict_unequal": lambda spark, sf: compared(spark, sf, UNEQUAL).verdict(),
    "q28_verdict_one_sided": lambda spark, sf: compared(spark, sf, ONE_SIDED_PAIR).verdict(),
    "q19_wide_decimals": lambda spark, sf: compared(spark, sf, DECIMALS).column_stats().drop("source_type", "target_type"),
    "q37_whole_lines_stats": lambda spark, sf: compared(spark, sf, WHOLE_LINES).column_stats().drop("source_type", "target_type"),
    "q37_repeated_texts_stats": lambda spark, sf: compared(spark, sf, REPEATED_TEXTS).column_stats().drop("source_type", "target_type"),
    "q29_matched_sample": lambda spark, sf: compared(spark, sf, ORDERS).matched_sample(),
    "q30_mismatch_samples": lambda spark, sf: compared(spark, sf, ORDERS).mismatch_samples(),
    "q31_one_sided_samples": one_sided_samples,
    "q32_summary_document": summary_document,
    "q32_report_overview": report_overview,
    "q33_job_latest_state": job_latest_state,
    "q34_job_result_kind": job_result_kind,
    "q34_job_status": job_status,
    "q35_run_records": run_records,
    "q36_hot_key_pairing": hot_pairing(HOT_KEYS),
    "q36_hot_key_status": hot_status(HOT_KEYS),
    "q37_hot_copies_status": hot_status(COPIES),
    "q37_hot_copies_pairing": hot_pairing(COPIES),
    "q38_extract_and_compare": extract_and_compare,
    "q39_published_dataset": published,
    "q39_published_once": published_once,
    "q14_key_counts_lines": key_counts(LINES),
    "q14_key_counts_null_keys": key_counts(NULL_KEYS),
    "q14_key_counts_hot_copies": key_counts(COPIES),
    "q25_wide_column_stats": column_stats(WIDE),
    "q25_wide_stats_while_storing": stored_stats(WIDE),
    "q36_whole_events_pairing": hot_pairing(WHOLE_EVENTS),
    "q32_report_differences": report_differences,
}
