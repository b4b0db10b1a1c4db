"""Sinks, the ledger and whole jobs."""

from __future__ import annotations

import csv
import glob
import json
import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.pairs import LINES, ORDERS
from tallybridge import SpecError, reconcile
from tallybridge.plans.jobs import COMPARE_FAILED, EXTRACT_FAILED, compare_datasets, extract_pair, together
from tallybridge.plans.report import report, summary_json
from tallybridge.sinks.ledger import (
    FAILED,
    FINISHED,
    LOOKUP_FAILED,
    NOT_FOUND,
    Ledger,
    latest_state,
    parsed_runs,
    result_kinds,
    status_of,
)
from tallybridge.sinks.tables import publish, publish_rows, published_name, read_published, save_csv, save_parquet
from tallybridge.sources.spec import QUERY, SourceSpec

EVENTS = "job_id string, status string, progress double, result_path string, error string, updated_at timestamp, seq long"


def text_of(folder):
    parts = sorted(glob.glob(f"{folder}/part-*"))
    return "".join(open(part, encoding="utf-8").read() for part in parts)


def test_parquet_is_overwritten(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    save_parquet(spark.range(5), path)
    save_parquet(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3


def test_publish_keeps_every_part(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    save_parquet(spark.range(100).repartition(5), path)
    assert len(glob.glob(f"{path}/part-*")) == 5
    uri = publish(spark, path, str(tmp_path / "box"), "extract-7")
    assert uri.endswith("/extract-7/t.parquet")
    assert spark.read.parquet(uri).count() == 100
    assert published_name("a/b.parquet/") == "b.parquet"
    assert publish(spark, path, str(tmp_path), name="own").endswith("/own")


def test_only_whole_publications_are_read(spark, tmp_path):
    uri = str(tmp_path / "box" / "t.parquet")
    publish_rows(spark.range(100).repartition(4), uri)
    assert read_published(spark, uri).count() == 100
    # A stray file of another attempt is not part of it; a lost one is noticed.
    spark.range(7).write.mode("append").parquet(uri)
    assert read_published(spark, uri).count() == 100
    publish_rows(spark.range(5), uri)
    assert read_published(spark, uri).count() == 5
    os.remove(sorted(glob.glob(f"{uri}/part-*"))[0])
    with pytest.raises(FileNotFoundError):
        read_published(spark, uri)
    # Data without a manifest is an unfinished publication.
    unfinished = str(tmp_path / "u.parquet")
    save_parquet(spark.range(5), unfinished)
    with pytest.raises(FileNotFoundError):
        read_published(spark, unfinished)


def test_the_first_failure_cancels_the_other_side(spark):
    def slow():
        wait = F.udf(lambda i: time.sleep(0.05) or i, "long")
        spark.range(0, 100_000, numPartitions=4).select(wait("id").alias("i")).agg(F.sum("i")).collect()

    def broken():
        time.sleep(1)
        raise ValueError("no such side")

    begin = time.time()
    with pytest.raises(ValueError, match="no such side"):
        together(spark, {"a": slow, "b": broken})
    assert time.time() - begin < 120
    assert together(spark, {"a": lambda: "x", "b": lambda: "y"}) == {"a": "x", "b": "y"}


def test_lookups_in_a_broken_ledger_answer_with_a_state(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    ledger.finished("j", str(tmp_path / "body.json"))
    (tmp_path / "body.json").write_text("{not json")
    assert ledger.status("j")["status"] == FINISHED
    assert ledger.result("j") == {"job_id": "j", "result": {}}
    for part in glob.glob(f"{tmp_path}/job_events/*/part-*"):
        with open(part, "wb") as handle:
            handle.write(b"broken")
    for crc in glob.glob(f"{tmp_path}/job_events/*/.*.crc"):
        os.remove(crc)
    assert ledger.status("j") == {"job_id": "j", "status": LOOKUP_FAILED, "progress": 0.0}
    assert ledger.result("j") == {"job_id": "j", "result": {}}


def test_equal_values_are_stored_once(spark, tmp_path):
    source = spark.range(4_000).selectExpr("id", *[f"sha2(CAST(id + {i} AS STRING), 256) AS c{i}" for i in range(4)])
    target = source.where("id % 50 <> 0").withColumn("c1", F.expr("IF(id % 7 = 0, NULL, c1)"))
    source.write.parquet(str(tmp_path / "side"))
    kept = reconcile(source, target, ["id"]).stored()
    sizes = [
        sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
        for df in (kept.classified, spark.read.parquet(str(tmp_path / "side")))
    ]
    assert sizes[0] < 1.5 * sizes[1]
    lazy = reconcile(source, target, ["id"])
    for name in ("matched_rows", "source_only_rows", "target_only_rows", "row_status", "column_stats"):
        found, expected = getattr(kept, name)().collect(), getattr(lazy, name)().collect()
        assert sorted(map(repr, found)) == sorted(map(repr, expected))
    kept.close()


def test_stored_values_come_back_as_they_were(spark):
    ddl = "k int, f float, d double, n decimal(5,2), t string, b binary, a array<int>, x int"
    left = [
        (1, 0.0, -0.0, Decimal("1.10"), "a", b"a", [1], 1),
        (2, float("nan"), None, None, None, None, None, None),
        (3, 1.5, 2.5, Decimal("2.00"), "", b"", [], 3),
        (4, 1.5, 2.5, None, "x", b"x", [None], None),
    ]
    right = [
        (1, -0.0, 0.0, Decimal("1.10"), "A", b"b", [1], 2),
        (2, float("nan"), 0.0, None, None, None, None, None),
        (3, 1.5, None, Decimal("2.00"), "", b"", None, 3),
        (5, 0.0, None, None, None, None, None, 7),
    ]
    a, b = spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl)
    lazy, kept = reconcile(a, b, ["k"]), reconcile(a, b, ["k"]).stored()
    for name in ("matched_rows", "source_only_rows", "target_only_rows", "row_status", "column_stats"):
        found, expected = getattr(kept, name)(), getattr(lazy, name)()
        assert found.schema.simpleString() == expected.schema.simpleString()
        assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))
    kept.close()


def test_empty_sides_are_measured_too(spark):
    none = spark.createDataFrame([], "id long, v double, t string")
    some = spark.createDataFrame([(1, 2.0, "a")], "id long, v double, t string")
    for source, target, counts in ((none, none, (0, 0)), (some, none, (1, 0)), (none, some, (0, 1))):
        rec = reconcile(source, target, ["id"])
        kept = rec.stored()
        lazy = rec.column_stats().orderBy("position").collect()
        assert kept.column_stats().orderBy("position").collect() == lazy
        assert [(r["matches"], r["total"], r["percent"], r["max_diff"]) for r in lazy] == [
            (0, 0, None, 0.0), (0, 0, None, None), (0, 0, None, 0.0),
        ]
        assert tuple(kept.row_summary().first())[:2] == counts
        assert kept.row_summary().collect() == rec.row_summary().collect()
        kept.close()


def test_csv_is_quoted_and_skipped_when_empty(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    df = spark.createDataFrame(
        [(1, 'say "hi"', "a\\b", None, [1, 2]), (2, "x,y", "line\nbreak", 1.5, None)],
        "id int, q string, s string, v double, l array<int>",
    ).coalesce(1)
    assert save_csv(df, path)
    raw = text_of(path)
    assert raw.splitlines()[0] == '"id","q","s","v","l"'
    assert '"say ""hi"""' in raw and '"a\\\\b"' in raw
    with open(glob.glob(f"{path}/part-*")[0], newline="", encoding="utf-8") as handle:
        parsed = list(csv.reader(handle, doublequote=True, escapechar="\\"))
    assert parsed[1] == ["1", 'say "hi"', "a\\b", "", "[1,2]"]
    assert parsed[2][:4] == ["2", "x,y", "line\nbreak", "1.5"]
    assert not save_csv(df.where("id > 5"), str(tmp_path / "none.csv"))
    assert not os.path.exists(tmp_path / "none.csv")


def test_summary_json(spark, sf_dir):
    source, target = ORDERS.load(spark, sf_dir)
    document = json.loads(summary_json(reconcile(source, target, ORDERS.keys)).first()["value"])
    assert list(document) == [
        "fecha_generacion", "nombre_df1", "nombre_df2",
        "metricas", "estructura", "estado_comparacion",
    ]
    assert document["metricas"]["filas_intersectadas"] == 1470
    assert document["estructura"]["columnas_unicas_df2"] == ["channel"]
    assert document["estado_comparacion"] == {
        "dataframes_identicos": False,
        "tolerancia_absoluta": 0.0001,
        "tolerancia_relativa": 0.0,
    }


def test_report_of_identical_sides_has_no_fifth_section(spark, sf_dir):
    source, _ = ORDERS.load(spark, sf_dir)
    lines = report(reconcile(source, source, ORDERS.keys).stored()).collect()
    assert {r["section"] for r in lines} == {0, 1, 2, 3, 4}
    assert "- ¿Son DataFrames idénticos? True" in {r["text"] for r in lines}


def test_report_lines_are_numbered_once(spark, sf_dir):
    source, target = LINES.load(spark, sf_dir)
    rec = reconcile(source, target, LINES.keys).stored()
    lines = report(rec).collect()
    places = [(r["section"], r["line_no"]) for r in lines]
    assert len(places) == len(set(places))
    assert sum(r["text"].startswith("source only: ") for r in lines) == 10
    assert sum(r["text"].startswith("l_quantity: l_orderkey=") for r in lines) == 10
    rec.close()


def test_whole_job(spark, sf_dir, tmp_path):
    for name, side in zip(("job_a", "job_b"), ORDERS.load(spark, sf_dir)):
        side.createOrReplaceTempView(name)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    pair = extract_pair(
        spark,
        SourceSpec(kind=QUERY, query="SELECT * FROM job_a", key=("ORDER_ID",), file_name="a"),
        SourceSpec(kind=QUERY, query="SELECT * FROM job_b"),
        str(tmp_path / "landed"),
        ledger=ledger,
        container=str(tmp_path / "box"),
    )
    assert pair.source.endswith(f"/box/{pair.job_id}/a.parquet")
    assert ledger.result(pair.job_id)["result"] == {"parquet_dir": pair.target}

    out = compare_datasets(
        spark,
        f"/moved/{os.path.basename(pair.source)}",
        pair.target,
        pair.keys,
        str(tmp_path / "out"),
        ledger=ledger,
        roots=[str(tmp_path / "box" / pair.job_id)],
    )
    assert ledger.status(out.job_id)["status"] == FINISHED
    body = ledger.result(out.job_id)["result"]
    assert body["metricas"]["filas_unicas_df1"] == 15
    assert text_of(out.report).startswith("REPORTE DETALLADO")
    assert text_of(out.source_only).count("\n") >= 16
    assert spark.read.option("header", True).csv(out.matched).count() == 1470
    runs = parsed_runs(ledger.runs())
    assert runs.count() == 5
    assert runs.where("columna = 'status'").first()["matches"] == 1345


def test_failed_comparison_is_recorded_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        compare_datasets(spark, "/no/a", "/no/b", ["id"], str(tmp_path), ledger=ledger)
    job = latest_state(ledger.events()).first()
    assert (job["status"], job["error"], job["progress"]) == (FAILED, COMPARE_FAILED, 1.0)
    run = parsed_runs(ledger.runs()).first()
    assert (run["state"], run["error"]) == ("error", COMPARE_FAILED)
    assert ledger.result(job["job_id"])["result"] == {"error": COMPARE_FAILED}


def test_failing_side_fails_the_extraction(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path))
    good = SourceSpec(kind=QUERY, query="SELECT 1 AS id", file_name="good")
    bad = SourceSpec(kind=QUERY, query="SELECT * FROM no_such_view", file_name="bad")
    with pytest.raises(Exception, match="no_such_view"):
        extract_pair(spark, bad, good, str(tmp_path), ledger=ledger)
    job = latest_state(ledger.events()).first()
    assert (job["status"], job["error"]) == (FAILED, EXTRACT_FAILED)
    with pytest.raises(SpecError):
        extract_pair(spark, good, good, str(tmp_path))


def test_identical_pair_writes_no_one_sided_files(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    save_parquet(spark.range(4), path)
    out = compare_datasets(spark, path, path, ["id"], str(tmp_path / "out"))
    assert (out.source_only, out.target_only) == (None, None)
    assert out.matched is not None


def test_empty_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "none"))
    assert ledger.status("x") == {"job_id": "x", "status": NOT_FOUND, "progress": 0.0}
    assert ledger.result("x") == {"job_id": "x", "result": {}}
    assert ledger.runs().count() == 0


def test_latest_state_and_kinds(spark, rows):
    from datetime import datetime

    noon, later = datetime(2024, 1, 1, 12), datetime(2024, 1, 1, 13)
    events = spark.createDataFrame(
        [
            ("a", "in_progress", 0.0, None, None, noon, 1),
            ("a", "finished", 1.0, "x/y.json", None, later, 2),
            ("b", "in_progress", 0.0, None, None, noon, 4),
            ("b", "failed", 1.0, None, "broken", noon, 5),
            ("c", "finished", 1.0, "x/z.parquet", None, noon, 6),
            ("d", "in_progress", 0.0, None, None, noon, 7),
        ],
        EVENTS,
    )
    assert rows(result_kinds(events)) == [
        ("a", "json"), ("b", "error"), ("c", "parquet"), ("d", "empty"),
    ]
    asked = spark.createDataFrame([("a",), ("z",), ("a",)], "job_id string")
    assert rows(status_of(events, asked)) == [("a", "finished", 1.0), ("z", NOT_FOUND, 0.0)]
