"""Bad input raises where it enters, and a validated caller can opt out."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import day, factor_table
from pyspark.sql import functions as F

from panelyard.operators import composite as cp
from panelyard.operators import evaluation as ev
from panelyard.operators import frictions as fr
from panelyard.operators import neutralization, portfolio, splits
from panelyard.operators import sample_weights as sw
from panelyard.operators import screening as sc
from panelyard.plans import ingest
from panelyard.plans.workflows import Neutralization, prepare_signals
from panelyard.sources.tables import TABLE_SCHEMAS, read_standard_tables

EVENTS = "sample_id int, date date, event_start date, event_end date, r double"


def events(spark, *extra):
    rows = [(i, day(i), day(i), day(i + 2), 0.1 * i) for i in range(6)]
    return spark.createDataFrame(rows + list(extra), EVENTS)


@pytest.mark.parametrize(
    "row", [(9, None, day(1), day(2), 0.1), (9, day(1), None, day(2), 0.1), (9, day(1), day(1), None, 0.1), (9, day(1), day(3), day(2), 0.1)]
)
def test_broken_intervals(spark, row):
    df = events(spark, row)
    for call in (
        lambda: splits.purged_kfold_split(df, n_splits=2), lambda: splits.combinatorial_purged_split(df, n_groups=3, n_test_groups=1),
        lambda: splits.purged_validation_summary(df, n_splits=2), lambda: sw.build_sample_weights(df),
    ):
        with pytest.raises(ValueError, match="contract"):
            call()
    splits.purged_kfold_split(df, n_splits=2, validate=False)


def test_more_folds_than_dates(spark):
    with pytest.raises(ValueError, match="decision dates"):
        splits.purged_kfold_split(events(spark), n_splits=7)


def test_repeated_sample_ids(spark):
    with pytest.raises(ValueError, match="duplicate_key=1"):
        sw.build_sample_weights(events(spark, (3, day(1), day(1), day(2), 0.1)))


def test_negative_weight_components(spark):
    df = spark.createDataFrame([(1, 1.0, -0.1), (2, 1.0, None)], "sample_id int, a double, b double")
    with pytest.raises(ValueError, match="negative_b=1"):
        sw.combine_weight_components(df, ["a", "b"])


def test_repeated_keys_of_pairs(spark):
    f = factor_table(spark, [(day(1), a, "f", float(i)) for i, a in enumerate("abc")])
    y = factor_table(spark, [(day(1), a, "y", float(i)) for i, a in enumerate("abc")])
    for call in (ev.compute_ic, ev.compute_rank_ic, ev.quantile_returns):
        for left, right in ((f.unionByName(f.limit(1)), y), (f, y.unionByName(y.limit(1)))):
            with pytest.raises(ValueError, match="duplicate_key=1"):
                call(left, right)
    assert ev.compute_ic(f, y).first()["ic"] == pytest.approx(1.0)


@pytest.mark.parametrize("adv, vol", [(None, 0.1), (-1.0, 0.1), (1e6, None), (1e6, -0.1), (1e6, float("nan"))])
def test_unusable_cost_inputs(spark, adv, vol):
    df = spark.createDataFrame([(day(1), "a", 100.0, 1e6, 0.02), (day(1), "b", 100.0, adv, vol)], "date date, asset string, trade_dollar double, adv_dollar double, daily_volatility double")
    with pytest.raises(ValueError, match="trades breaks its contract"):
        fr.layered_research_costs(df)
    assert fr.cost_per_trade(df, validate=False).count() == 2


def test_raw_tables(spark):
    daily = spark.createDataFrame([("a", "20240102", "1.5"), ("b", "20240102", "n/a")], "ts_code string, trade_date string, close string")
    basic = spark.createDataFrame([("a", "20240102")], "ts_code string, trade_date string")
    stock = spark.createDataFrame([("a",)], "ts_code string")
    with pytest.raises(ValueError, match="daily breaks its contract: non_numeric_close=1"):
        ingest.validate_raw_tables({"daily": daily, "daily_basic": basic, "stock_basic": stock})


def test_absent_indicators_read_as_an_empty_table(spark, tmp_path):
    for name, schema in TABLE_SCHEMAS.items():
        if name != "financial_indicators":
            spark.createDataFrame([], schema).write.parquet(str(tmp_path / name))
    assert read_standard_tables(spark, str(tmp_path))["financial_indicators"].count() == 0


PAIRS = "alpha_a string, alpha_b string, corr double"


def test_effective_count_of_an_improper_matrix(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", -0.9)], PAIRS)
    assert cp.breadth_summary(pairs).first()["effective_breadth"] == pytest.approx(2.0)
    with pytest.raises(ValueError, match="missing"):
        cp.breadth_summary(spark.createDataFrame([("a", "b", None)], PAIRS))
    with pytest.raises(ValueError, match="3 pairs"):
        cp.breadth_summary(pairs.limit(2))


def test_a_pool_of_one_alpha(spark):
    out = cp.alpha_pool_diagnostics(spark.createDataFrame([(day(i), "only", 0.1 * i) for i in range(5)], "date date, factor string, value double"))
    assert tuple(out["breadth_summary"].select("n_alphas", "effective_breadth", "breadth_ratio").first()) == (1, 1.0, 1.0)
    assert [tuple(r) for r in out["clusters"].collect()] == [(0, 1, "only")]


def test_fewer_than_two_factors(spark):
    one = spark.createDataFrame([("f", "candidate_factor", 0.1, 1.0)], "factor string, decision string, rank_ic_mean double, coverage double")
    with pytest.raises(ValueError, match="fewer than two"):
        sc.select_signals(factor_table(spark, [(day(1), "a", "f", 1.0)]), one)


def exposed(spark):
    rng = np.random.default_rng(5)
    rows = [(day(0), f"a{i:02d}", "f", float(rng.normal() + 0.3 * i), float(i), float(rng.normal())) for i in range(30)]
    return spark.createDataFrame(rows, "date date, asset string, factor string, value double, size_exposure double, beta_exposure double"), rows


def test_ridge_is_applied(spark):
    df, rows = exposed(spark)
    out = neutralization.neutralize_signal(df, size_col="size_exposure", beta_col="beta_exposure", ridge=100.0)["data"].orderBy("asset").collect()
    x = np.array([[1.0, r[4], r[5]] for r in rows])
    y = np.array([r[3] for r in rows])
    want = y - x @ np.linalg.solve(x.T @ x + 100.0 * np.eye(3), x.T @ y)
    np.testing.assert_allclose([r["value_neutralized"] for r in out], want)
    with pytest.raises(ValueError, match="closed form"):
        neutralization.neutralize_signal(df, size_col="size_exposure", ridge=1.0, solver="closed_form")


def test_ridge_is_applied_through_the_workflow_step(spark):
    df, _ = exposed(spark)
    masks = {"universe": df.select("date", "asset", F.lit(True).alias("in_universe")), "tradability": df.select("date", "asset", F.lit(True).alias("is_tradable"))}
    run = lambda ridge: [r[0] for r in prepare_signals(
        df.select("date", "asset", "factor", "value"), masks, exposures=df, neutralization=Neutralization(size_col="size_exposure", beta_col="beta_exposure", ridge=ridge)
    ).orderBy("asset").select("value").collect()]
    plain, strong = run(1e-8), run(100.0)
    assert None not in strong and max(abs(a - b) for a, b in zip(plain, strong, strict=True)) > 1e-3


def exchanges(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_panel_is_moved_on_a_date_alone(spark):
    """With broadcasts by size switched off, as for a side of unknown size."""
    rows = [(day(i), f"a{j}", "f", float(i * j % 5)) for i in range(12) for j in range(6)]
    factors, returns = factor_table(spark, rows), factor_table(spark, rows).select("date", "asset", "value")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assigned = factors.select("date", "asset", "factor", F.ntile(2).over(ev.W.partitionBy("date").orderBy("value", "asset")).alias("quantile"))
        weights = factors.select("date", "asset", F.col("value").alias("weight"))
        assert "SortMergeJoin" not in exchanges(ev.quantile_turnover(assigned)) and "SortMergeJoin" not in exchanges(portfolio.weight_changes(weights))
        simulated = exchanges(portfolio.simulate_portfolio_returns(weights, returns, holding_period=3))
        assert simulated.count("SortMergeJoin [date") == 1 and "SortMergeJoin [date#" in simulated  # returns with positions, on date and asset
        folds = splits.walk_forward_split(factors, train_size=4, test_size=3, step=2)
        assert "SortMergeJoin" not in exchanges(splits.with_fold(factors, folds))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_masks_and_signal_meet_one_to_one(spark):
    from panelyard.operators.target_weights import executable_mask

    keys = [(day(1), "a"), (day(1), "b"), (day(2), "a")]
    signal = spark.createDataFrame([(*k, 1.0) for k in keys], "date date, asset string, signal_value double")
    universe = spark.createDataFrame([(*k, True) for k in keys[:2]] + [(day(9), "z", None)], "date date, asset string, in_universe boolean")
    tradable = spark.createDataFrame([(*k, None if k[1] == "b" else True) for k in keys], "date date, asset string, is_tradable boolean")
    rows = sorted(map(tuple, executable_mask(signal, universe, tradable).collect()))
    assert rows == [(day(1), "a", 1.0, True, True, True), (day(1), "b", 1.0, True, False, False)]
    assert all(r["is_executable"] for r in executable_mask(signal, universe, tradable, trade_when_not_tradable=True).collect())
    tables = [signal, universe, tradable]
    for i in range(3):
        twice = [t.unionByName(t.limit(1)) if j == i else t for j, t in enumerate(tables)]
        with pytest.raises(Exception, match="one to one"):
            executable_mask(*twice).collect()
