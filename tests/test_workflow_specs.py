"""Defaults and checks of workflow specs, and many experiments in one plan."""

from __future__ import annotations

import pytest
from helpers import random_prices
from pyspark.sql import functions as F

from panelyard.operators.factors import low_volatility, momentum, reversal
from panelyard.operators.verdicts import CompositeThresholds, SingleFactorThresholds
from panelyard.plans import workflows as wk

FN = lambda p: reversal(p, window=2)


def test_defaults():
    s = wk.SingleFactorSpec(factor_fn=FN)
    assert (s.horizon, s.n_quantiles, s.label_method, s.validation_mode, s.n_splits, s.embargo_periods) == (5, 5, "forward_return", "purged_kfold", 5, 0)
    assert (s.train_size, s.test_size, s.step, s.val_size) == (252, 63, 63, 0)
    assert (s.screening_min_abs_monotonicity, s.screening_max_pairwise_corr, s.screening_max_vif, s.neutralization) == (0.1, 0.95, 20.0, None)
    c = wk.CompositeSpec()
    assert (c.horizon, c.composite_method, c.composite_lookback, c.composite_min_history) == (5, "icir", 63, 10)
    assert (c.portfolio.long_top_k, c.portfolio.short_bottom_k, c.portfolio.weighting_method) == (20, 20, "equal")
    assert (c.portfolio_value, c.adv_window, c.max_adv_participation, c.costs) == (1e7, 20, 0.05, {"flat_fee_bps": 1.0, "spread_bps": 5.0, "impact_eta": 0.1})
    p = wk.Preprocess()
    assert (p.winsorize, p.lower, p.upper, p.zscore, p.rank, p.min_group_size, p.min_coverage) == (True, 0.01, 0.99, True, False, 3, None)


@pytest.mark.parametrize("make", [
    lambda: wk.SingleFactorSpec(factor_fn=FN, experiment_name="  "), lambda: wk.SingleFactorSpec(factor_fn=FN, horizon=0), lambda: wk.SingleFactorSpec(factor_fn=FN, n_quantiles=1),
    lambda: wk.SingleFactorSpec(factor_fn=FN, validation_mode="other"), lambda: wk.SingleFactorSpec(factor_fn=FN, validation_mode="single_split", train_end="2024-01-01"),
    lambda: wk.SingleFactorSpec(factor_fn=FN, n_splits=1), lambda: wk.SingleFactorSpec(factor_fn=FN, validation_mode="walk_forward", step=0),
    lambda: wk.CompositeSpec(experiment_name=""), lambda: wk.CompositeSpec(portfolio_value=0), lambda: wk.CompositeSpec(adv_window=1),
    lambda: wk.CompositeSpec(portfolio=wk.pf.Strategy(long_top_k=5)), lambda: wk.CompositeSpec(thresholds=CompositeThresholds(min_selected_factors=1)),
    lambda: wk.Preprocess(lower=0.5, upper=0.5), lambda: wk.Preprocess(upper=1.1), lambda: wk.Preprocess(min_group_size=0), lambda: wk.Preprocess(min_coverage=0.0),
    lambda: wk.Neutralization(), lambda: wk.Neutralization(size_col="s", min_obs=0), lambda: wk.Neutralization(size_col="s", ridge=-1.0),
])
def test_bad_specs_raise(make):
    with pytest.raises(ValueError):
        make()


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=str)


def test_many_experiments_equal_single_ones(spark):
    """Factor, trial count, gates and thresholds differ within a plan; horizon and validation make other plans."""
    prices = random_prices(spark, 12, 60).withColumns({"volume": F.lit(1e5), "dollar_volume": F.col("close") * 1e5})
    meta = prices.select("asset").distinct().withColumns({"listing_date": F.lit("2020-01-01").cast("date"), "is_st": F.lit(False)})
    specs = [
        wk.SingleFactorSpec(FN, "a", horizon=2), wk.SingleFactorSpec(lambda p: momentum(p, window=4), "b", horizon=2, trial_count=7),
        wk.SingleFactorSpec(lambda p: low_volatility(p, window=5), "c", horizon=2, thresholds=SingleFactorThresholds(min_coverage=0.99), screening_min_abs_monotonicity=0.9),
        wk.SingleFactorSpec(lambda p: momentum(p, window=3).unionByName(momentum(p, window=5)), "pair", horizon=2),
        wk.SingleFactorSpec(FN, "wf", horizon=1, validation_mode="walk_forward", train_size=20, test_size=10, step=10, label_method="rankpct"),
        wk.SingleFactorSpec(FN, "split", horizon=1, validation_mode="single_split", train_end="2024-01-20", test_start="2024-01-25"),
    ]
    given = dict(asset_metadata=meta, max_group=12)
    many = wk.run_single_factor_workflows(prices, specs, **given)
    verdicts, decisions = many["verdict"], many["decisions"]
    assert {r[0] for r in verdicts.select("experiment").distinct().collect()} == {s.experiment_name for s in specs} and verdicts.count() == 7
    for s in specs:
        one = wk.run_single_factor_workflow(prices, s, **given)
        assert rows(verdicts.where(F.col("experiment") == s.experiment_name).drop("experiment")) == rows(one["verdict"])
        assert rows(decisions.where(F.col("experiment") == s.experiment_name).drop("experiment")) == rows(one["decisions"])
    with pytest.raises(ValueError, match="names that differ"):
        wk.run_single_factor_workflows(prices, [specs[0], specs[0]], **given)


def test_jobs_do_not_grow_with_the_specs(spark):
    """Twenty specs of one plan start about as many jobs as one, far fewer than three single runs."""
    prices = random_prices(spark, 8, 40).withColumns({"volume": F.lit(1e5), "dollar_volume": F.col("close") * 1e5})
    meta = prices.select("asset").distinct().withColumns({"listing_date": F.lit("2020-01-01").cast("date"), "is_st": F.lit(False)})
    tracker = spark.sparkContext.statusTracker()

    def jobs(n: int) -> int:
        group = f"specs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        specs = [wk.SingleFactorSpec(lambda p, w=w: momentum(p, window=2 + w), f"m{w}", horizon=1) for w in range(n)]
        assert wk.run_single_factor_workflows(prices, specs, asset_metadata=meta, max_group=200)["verdict"].count() == n
        return len(tracker.getJobIdsForGroup(group))

    try:
        one, twenty = jobs(1), jobs(20)
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert twenty < 1.5 * one
