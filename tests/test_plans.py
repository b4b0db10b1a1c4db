"""The shape of the physical plans, with broadcasting by size switched off."""

from __future__ import annotations

import re

import pytest

from checks.pairs import HOT_KEYS, LINES, NULL_KEYS, ORDERS, WIDE
from tallybridge import count_rows, reconcile
from tallybridge.operators.keys import duplicate_keys, key_ordinals
from tallybridge.sinks.ledger import latest_state
from checks.pairs import load
from checks.queries import JOB_LOG


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def build(spark, sf_dir, pair, **options):
    source, target = pair.load(spark, sf_dir)
    return reconcile(source, target, pair.keys, **options)


def wide_exchanges(text):
    """Shuffles that move rows, not the single row of a global aggregate."""
    return [
        line
        for line in text.splitlines()
        if re.search(r"[ +-]Exchange (hash|range|round)", line)
    ]


def test_nothing_is_nested_loop_or_python(spark, sf_dir, plan):
    for pair in (ORDERS, LINES, NULL_KEYS):
        rec = build(spark, sf_dir, pair)
        for df in (
            rec.row_summary(),
            rec.column_stats(),
            rec.matched_rows(),
            rec.source_only_rows(),
            rec.target_only_rows(),
            rec.mismatch_samples(),
            rec.matched_sample(),
        ):
            text = plan(df)
            for bad in ("NestedLoop", "Cartesian", "Python", "ArrowEval"):
                assert bad not in text, (bad, text)


def test_unique_keys_use_one_merge_join(spark, sf_dir, plan):
    rec = build(spark, sf_dir, ORDERS)
    text = plan(rec.row_summary())
    assert "SortMergeJoin" in text and "FullOuter" in text
    assert len(wide_exchanges(text)) == 2


def test_matched_rows_narrow_to_an_inner_join(spark, sf_dir, plan):
    rec = build(spark, sf_dir, ORDERS)
    for df in (rec.column_stats(), rec.matched_rows(), rec.matched_sample()):
        text = plan(df)
        assert "Inner" in text and "FullOuter" not in text


def test_column_stats_read_shared_columns_only(spark, sf_dir, plan):
    text = plan(build(spark, sf_dir, ORDERS).column_stats())
    assert "o_orderpriority" not in text


def test_row_counts_read_keys_only(spark, sf_dir, plan):
    rec = build(spark, sf_dir, ORDERS)
    text = plan(rec.row_status())
    assert "o_totalprice" not in text and "o_orderstatus" not in text


def test_one_sided_rows_use_an_anti_join_on_keys(spark, sf_dir, plan):
    text = plan(build(spark, sf_dir, ORDERS).source_only_rows())
    assert "LeftAnti" in text
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and sum("o_totalprice" in line for line in scans) == 1


def test_duplicates_take_one_shuffle(spark, sf_dir, plan):
    for pair in (LINES, NULL_KEYS):
        text = plan(build(spark, sf_dir, pair).row_summary())
        assert len(wide_exchanges(text)) == 1, text


def test_filters_reach_the_scan(spark, sf_dir, plan):
    rec = build(spark, sf_dir, ORDERS)
    assert "PushedFilters: [IsNotNull(o_orderkey)]" in plan(rec.column_stats())


def test_samples_are_cut_before_they_are_shuffled(spark, sf_dir, plan):
    rec = build(spark, sf_dir, ORDERS)
    text = plan(rec.mismatch_samples())
    assert "partial_collect_top_k" in text and "ObjectHashAggregate" in text
    aggregated = text[: text.index("partial_collect_top_k")]
    assert "Sort" not in aggregated and "Window" not in text
    assert "TakeOrderedAndProject" in plan(rec.matched_sample())
    assert "TakeOrderedAndProject" in plan(rec.source_only_sample())


def test_hot_keys_are_paired_on_key_and_ordinal(spark, sf_dir, plan):
    rec = build(spark, sf_dir, HOT_KEYS, hot_key_rows=50, rows_per_range=100)
    text = plan(rec.row_summary())
    assert re.search(r"Exchange hashpartitioning\(_k0#\d+, _ord#\d+L", text)
    # Forced broadcasts: the list of hashes, for either side, and the ranges' starting numbers.
    assert text.count("BroadcastExchange") == 3
    ordinals = plan(key_ordinals(load(spark, sf_dir, HOT_KEYS.source), HOT_KEYS.keys, 50, 100))
    assert ordinals.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in ordinals


def test_wide_tables_are_measured_in_one_scan(spark, sf_dir, plan):
    rec = build(spark, sf_dir, WIDE)
    text = plan(rec.column_stats())
    assert text.count("FileScan") == 2 and len(wide_exchanges(text)) == 3
    assert "FullOuter" not in text


def test_stored_measures_need_no_scan(spark, sf_dir, plan):
    rec = build(spark, sf_dir, LINES).stored()
    for df in (rec.row_summary(), rec.column_stats(), rec.verdict()):
        assert "FileScan" not in plan(df) and "Exchange hash" not in plan(df)
    rec.close()


def test_key_counts_have_no_window_and_no_sort(spark, sf_dir, plan):
    for pair in (ORDERS, LINES, NULL_KEYS, HOT_KEYS):
        text = plan(count_rows(*pair.load(spark, sf_dir), pair.keys))
        assert len(wide_exchanges(text)) == 1 and "partial_count" in text
        for bad in ("Window", "Sort", "Join"):
            assert bad not in text, text


def test_grouping_combines_before_the_shuffle(spark, sf_dir, plan):
    copies = plan(duplicate_keys(load(spark, sf_dir, LINES.source), LINES.keys))
    assert "partial_count" in copies
    assert "partial_max_by" in plan(latest_state(load(spark, sf_dir, JOB_LOG)))


def test_job_lookup_filters_the_scan(spark, sf_dir, plan):
    jobs = latest_state(load(spark, sf_dir, JOB_LOG)).where("job_id = 7")
    assert "EqualTo(user_id,7)" in plan(jobs)


def test_stored_rows_are_pruned_by_status(spark, sf_dir, plan):
    rec = build(spark, sf_dir, ORDERS).stored()
    text = plan(rec.source_only_rows())
    assert "PartitionFilters: [isnotnull(_status" in text and "Exchange" not in text
    rec.close()
