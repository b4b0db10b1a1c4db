"""Whole jobs: land a pair of relations, compare a pair of datasets."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

from tallybridge.errors import SpecError
from tallybridge.plans.reconcile import Reconciliation, reconcile
from tallybridge.plans.report import report, summary_json
from tallybridge.sinks.ledger import FINISHED, Ledger, new_id, result_document, run_record
from tallybridge.sinks.tables import publish_rows, save_csv, save_lines, save_parquet
from tallybridge.sources.files import read_parquet
from tallybridge.sources.jdbc import Connection
from tallybridge.sources.spec import SourceSpec, read_spec

# Base names of the result files.
SUMMARY_NAME = "comparacion_resumen"
REPORT_NAME = "comparacion_reporte_detallado"
SOURCE_ONLY_NAME = "comparacion_filas_unicas_df1"
TARGET_ONLY_NAME = "comparacion_filas_unicas_df2"
MATCHED_NAME = "comparacion_filas_intersectadas"

# What the ledger says about a failure; the exception itself goes to the caller.
EXTRACT_FAILED = "extraction failed"
COMPARE_FAILED = "comparison failed"


def together(spark: SparkSession, tasks: Mapping[str, Callable[[], str]]) -> dict[str, str]:
    """Run ``tasks`` at the same time; the first to fail cancels the others' Spark jobs."""
    context = spark.sparkContext
    tags = {name: new_id(f"tallybridge-{name}") for name in tasks}

    def tagged(name: str) -> str:
        context.addJobTag(tags[name])
        try:
            return tasks[name]()
        finally:
            context.removeJobTag(tags[name])

    with ThreadPoolExecutor(len(tasks)) as pool:
        running = {pool.submit(inheritable_thread_target(spark)(tagged), name): name for name in tasks}
        done, waiting = wait(running, return_when=FIRST_EXCEPTION)
        failed = [f for f in done if f.exception()]
        if failed:
            for future in waiting:
                # A job that starts after this is not cancelled, and ends on its own.
                context.cancelJobsWithTag(tags[running[future]])
            wait(waiting)
            raise failed[0].exception()
    return {name: future.result() for future, name in running.items()}


@dataclass(frozen=True)
class LandedPair:
    job_id: str
    source: str
    target: str
    keys: tuple[str, ...]


def extract_pair(
    spark: SparkSession,
    source: SourceSpec,
    target: SourceSpec,
    out: str,
    *,
    ledger: Ledger | None = None,
    connections: Mapping[str, Connection] | None = None,
    container: str | None = None,
) -> LandedPair:
    """Land both sides as Parquet, at the same time. One side failing fails the job.

    With a ``container`` they are written there at once, and published.
    """
    job_id = new_id("extract")
    if ledger:
        ledger.started(job_id)
    try:
        names = {
            "source": source.file_name or f"source_{job_id}",
            "target": target.file_name or f"target_{job_id}",
        }
        if names["source"] == names["target"]:
            raise SpecError(f"both sides would land as {names['source']}")

        def land(side: str, spec: SourceSpec) -> str:
            rows = read_spec(spark, spec, connections)
            if container:
                return publish_rows(rows, f"{container.rstrip('/')}/{job_id}/{names[side]}.parquet")
            path = f"{out.rstrip('/')}/{names[side]}.parquet"
            save_parquet(rows, path)
            return path

        places = together(spark, {"source": partial(land, "source", source), "target": partial(land, "target", target)})
    except Exception:
        if ledger:
            ledger.failed(job_id, EXTRACT_FAILED)
        raise
    if ledger:
        ledger.finished(job_id, places["target"])
    return LandedPair(job_id, places["source"], places["target"], source.key or target.key)


@dataclass(frozen=True)
class ComparisonOutputs:
    """Where each result was written; ``None`` for a row set that is empty."""

    job_id: str
    summary: str
    report: str
    source_only: str | None
    target_only: str | None
    matched: str | None


def compare_datasets(
    spark: SparkSession,
    source_path: str,
    target_path: str,
    keys: Sequence[str],
    out: str,
    *,
    ledger: Ledger | None = None,
    roots: Sequence[str] = (),
    **options,
) -> ComparisonOutputs:
    """Compare two landed datasets and write every result below ``out``.

    The classified rows are written once and all outputs read that table.
    ``options`` go to ``reconcile``.
    """
    job_id = new_id("compare")
    if ledger:
        ledger.started(job_id)
    try:
        rec = reconcile(
            read_parquet(spark, source_path, roots),
            read_parquet(spark, target_path, roots),
            keys,
            **options,
        )
        try:
            rec = rec.stored()
            outputs = _write_outputs(rec, out.rstrip("/"), job_id)
            if ledger:
                body = result_document(rec.column_stats())
                ledger.append_run(run_record(body, FINISHED))
        finally:
            rec.close()
    except Exception:
        if ledger:
            ledger.append_error(COMPARE_FAILED)
            ledger.failed(job_id, COMPARE_FAILED)
        raise
    if ledger:
        ledger.finished(job_id, outputs.summary)
    return outputs


def _write_outputs(rec: Reconciliation, out: str, job_id: str) -> ComparisonOutputs:
    def place(base: str, ending: str) -> str:
        return f"{out}/{base}_{job_id}.{ending}"

    summary_path, report_path = place(SUMMARY_NAME, "json"), place(REPORT_NAME, "txt")
    summary_json(rec).coalesce(1).write.mode("overwrite").text(summary_path)
    save_lines(report(rec), report_path)
    written = {}
    for base, rows in (
        (SOURCE_ONLY_NAME, rec.source_only_rows()),
        (TARGET_ONLY_NAME, rec.target_only_rows()),
        (MATCHED_NAME, rec.matched_rows()),
    ):
        path = place(base, "csv")
        written[base] = path if save_csv(rows, path) else None
    return ComparisonOutputs(
        job_id=job_id,
        summary=summary_path,
        report=report_path,
        source_only=written[SOURCE_ONLY_NAME],
        target_only=written[TARGET_ONLY_NAME],
        matched=written[MATCHED_NAME],
    )
