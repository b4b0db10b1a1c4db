"""The run ledger: append-only records of comparison runs and of job states.

Nothing is updated in place. The state of a job is its latest event, found by
an aggregate that combines on the map side, so a job with a very long history
costs no more than any other. Both tables are bucketed logs (``sinks.log``): a lookup
opens the one bucket of its job, and small files are folded together as they gather.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping
from datetime import datetime, timezone
from uuid import uuid4

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybridge.functions.sqltext import query, text
from tallybridge.sinks.log import Log
from tallybridge.sources.files import exists, is_folder

# Record fields and states that readers of the ledger expect.
RUN_SCHEMA = "run_id string, result_json string, state string, ts timestamp"
EVENT_SCHEMA = (
    "job_id string, status string, progress double, result_path string, "
    "error string, updated_at timestamp, seq long"
)
STAT_SCHEMA = "columna string, matches long, total long, percent double"
RESULT_SCHEMA = f"lines array<string>, column_stats array<struct<{STAT_SCHEMA}>>, error string"
IN_PROGRESS, FINISHED, FAILED = "in_progress", "finished", "failed"
RUN_ERROR = "error"
NOT_FOUND, LOOKUP_FAILED = "not_found", "error"

LOG = logging.getLogger(__name__)
# What a ledger or a result that can't be read raises.
UNREADABLE = (PySparkException, Py4JError, ValueError, OSError)

RESULT_KINDS = ("parquet", "json", "error", "empty")


def new_id(prefix: str) -> str:
    return f"{prefix}-{uuid4()}"


def result_document(stats: DataFrame) -> DataFrame:
    """The JSON body of a finished run, one row, from column statistics.

    The collected list has one entry per column of the compared tables.
    """
    return query(
        """
        SELECT to_json(
            named_struct(
                'lines', CAST(array() AS ARRAY<STRING>),
                'column_stats', transform(
                    array_sort(collect_list(struct(position, stat))), entry -> entry.stat)),
            map('ignoreNullFields', 'false')) AS result_json
        FROM (SELECT position,
                     struct(`column` AS columna, matches, total, percent) AS stat
              FROM {stats})
        """,
        stats=stats,
    )


def run_record(
    result: DataFrame, state: str, run_id: str | None = None, ts: datetime | None = None
) -> DataFrame:
    """One run row from a one-row relation with ``result_json``; now, unless ``ts`` says when."""
    when = f"TIMESTAMP {text(ts.isoformat(sep=' '))}" if ts else "current_timestamp()"
    return query(
        f"""
        SELECT {text(run_id or str(uuid4()))} AS run_id, result_json,
               {text(state)} AS state, {when} AS ts
        FROM {{result}}
        """,
        result=result,
    )


def parsed_runs(runs: DataFrame) -> DataFrame:
    """Run rows with their stored JSON decoded, one row per compared column."""
    return query(
        f"""
        SELECT run_id, state, ts, r.error AS error,
               inline_outer(r.column_stats)
        FROM (SELECT *, from_json(result_json, {text(RESULT_SCHEMA)}) AS r
              FROM {{runs}})
        """,
        runs=runs,
    )


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of every job, by time and then by sequence number."""
    return query(
        """
        SELECT job_id, last.* FROM (
            SELECT job_id,
                   max_by(struct(status, progress, result_path, error, updated_at, seq),
                          struct(updated_at, seq)) AS last
            FROM {events} GROUP BY job_id)
        """,
        events=events,
    )


def status_of(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Status and progress for every requested ``job_id``, known or not."""
    return query(
        f"""
        SELECT asked.job_id, coalesce(status, {text(NOT_FOUND)}) AS status,
               coalesce(progress, 0.0D) AS progress
        FROM (SELECT DISTINCT job_id FROM {{jobs}}) AS asked
        LEFT JOIN {{latest}} AS latest ON asked.job_id = latest.job_id
        """,
        jobs=jobs,
        latest=latest_state(events),
    )


def result_kinds(events: DataFrame) -> DataFrame:
    """What a lookup of each job would return, from its latest event."""
    dataset, document, failed, empty = map(text, RESULT_KINDS)
    return query(
        f"""
        SELECT job_id,
               CASE WHEN endswith(result_path, '.parquet') THEN {dataset}
                    WHEN endswith(result_path, '.json') THEN {document}
                    WHEN error != '' THEN {failed}
                    ELSE {empty} END AS kind
        FROM {{latest}}
        """,
        latest=latest_state(events),
    )


class Ledger:
    """Run and job records in two append-only tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        base = root.rstrip("/")
        # Runs are read as a whole.
        self._runs = Log(spark, f"{base}/runs", RUN_SCHEMA, "run_id", buckets=1)
        self._events = Log(spark, f"{base}/job_events", EVENT_SCHEMA, "job_id")

    def runs(self) -> DataFrame:
        return self._runs.read()

    def events(self, job_id: str | None = None) -> DataFrame:
        """All events, or those of one job."""
        return self._events.read(job_id)

    def compact(self) -> int:
        """Fold the small files of both tables together; how many buckets had any."""
        return self._runs.compact() + self._events.compact()

    def append_run(self, record: DataFrame) -> None:
        self._runs.append(record, "")

    def append_error(self, message: str) -> None:
        body = F.to_json(F.struct(F.lit(message).alias("error")))
        row = self._spark.range(1).select(body.alias("result_json"))
        self.append_run(run_record(row, RUN_ERROR))

    def started(self, job_id: str) -> None:
        self._event(job_id, IN_PROGRESS, 0.0)

    def finished(self, job_id: str, result_path: str) -> None:
        self._event(job_id, FINISHED, 1.0, result_path=result_path)

    def failed(self, job_id: str, error: str) -> None:
        self._event(job_id, FAILED, 1.0, error=error)

    def _event(
        self,
        job_id: str,
        status: str,
        progress: float,
        result_path: str | None = None,
        error: str | None = None,
    ) -> None:
        now = datetime.now(timezone.utc)
        seq = int(now.timestamp() * 1_000_000)
        row = (job_id, status, progress, result_path, error, now, seq)
        event = self._spark.createDataFrame([row], EVENT_SCHEMA)
        self._events.append(event, job_id)

    def _latest(self, job_id: str) -> Mapping | None:
        row = latest_state(self.events(job_id)).first()
        return row.asDict() if row else None

    def status(self, job_id: str) -> dict:
        """State and progress; ``error`` if the ledger itself can't be read."""
        try:
            job = self._latest(job_id)
        except UNREADABLE:
            LOG.exception("status of job %s", job_id)
            return {"job_id": job_id, "status": LOOKUP_FAILED, "progress": 0.0}
        if job is None:
            return {"job_id": job_id, "status": NOT_FOUND, "progress": 0.0}
        return {"job_id": job_id, "status": job["status"], "progress": job["progress"]}

    def result(self, job_id: str) -> dict:
        """A pointer to a dataset, a JSON body, the error, or nothing.

        Nothing too if the ledger or the result can't be read.
        """
        try:
            return {"job_id": job_id, "result": self._result(job_id)}
        except UNREADABLE:
            LOG.exception("result of job %s", job_id)
            return {"job_id": job_id, "result": {}}

    def _result(self, job_id: str) -> dict:
        job = self._latest(job_id)
        path = job["result_path"] if job else None
        if path and exists(self._spark, path):
            if not is_folder(self._spark, path) or path.endswith(".json"):
                body = self._spark.read.text(path, wholetext=True).first()
                return json.loads(body["value"]) if body else {}
            return {"parquet_dir": path}
        if job and job["error"]:
            return {"error": job["error"]}
        return {}
