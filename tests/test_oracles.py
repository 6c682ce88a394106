"""Registered queries on the whole small tables against their SQL oracles.

By default one query per operator family; PANELYARD_ALL_ORACLES=1 runs every registered query.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FAMILIES = """price_contract price_scan_csv standardized_market_state point_in_time_quality momentum_signal triple_barrier_label
trend_scanning_label rank_cross_section_range_split preprocess_chain exclusion_reasons rank_ic_range_split quantile_turnover signal_half_life
purged_kfold_split walk_forward_split sample_weight_table screening_decisions composite_weights_icir correlation_clusters
overlapping_portfolio_returns target_weights_long_short trade_costs_by_date skipped_reason_distribution single_factor_verdicts""".split()
NAMES = sorted(QUERIES) if os.environ.get("PANELYARD_ALL_ORACLES") else FAMILIES


@pytest.fixture(scope="module")
def con():
    from compare import connect

    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    from compare import compare

    ok, message, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_DIR)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
