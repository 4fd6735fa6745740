"""Registered queries against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

SAMPLE = [
    "S1_read_wide_csv", "P1_melt", "P7_material_parts", "A1_sum_duplicates", "V8_ranges", "V10_all_checks", "F0_series_ids",
    "F10_days_of_supply", "F13_zscore_vs_channel", "B7_all_models", "C1_walk_forward", "M13_roc_auc", "M14_youden_threshold",
    "R6_risk_table", "K7_churn_table", "L11_bias_factors", "L14_blend", "A17_deficit", "A22_correlation_matrix", "U1_runs",
    "D12_series_registry", "D17_stability_index", "D21_composite_risk", "D26_hierarchy_sums", "X1_file_arrivals",
]


@pytest.fixture(scope="module")
def con(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_duckdb(spark, sf, con, name):
    status, _, _, note = check.compare(spark, con, sf, name)
    assert status == "ok", note


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, sf):
    rows = entry.entry(spark).collect()
    assert rows and {"risk_level", "stockout_week", "weeks_of_supply"} <= set(rows[0].asDict())
