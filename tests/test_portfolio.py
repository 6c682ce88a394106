from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day, factor_table, frame, random_prices, values
from panelyard.operators import execution as ex
from panelyard.operators import frictions as fr
from panelyard.operators import portfolio as pf
from panelyard.operators import target_weights as tw
from panelyard.operators.labels import forward_return


def table(spark, rows, column="weight"):
    return spark.createDataFrame([(day(i), a, w) for i, a, w in rows], f"date date, asset string, {column} double")


def test_weights_never_overlap_and_skip_single_assets(spark):
    f = factor_table(spark, [(day(0), a, "f", v) for a, v in zip("ABCD", (4.0, 3.0, 2.0, 1.0))] + [(day(1), "A", "f", 1.0)])
    got = {r["asset"]: r["weight"] for r in pf.portfolio_weights(f, top_k=3, bottom_k=3).collect()}
    assert got == {"A": pytest.approx(1 / 3), "B": pytest.approx(1 / 3), "C": pytest.approx(1 / 3), "D": -1.0}
    rank = {r["asset"]: r["weight"] for r in pf.portfolio_weights(f, "rank", top_k=2, bottom_k=2).collect()}
    assert rank == {"A": pytest.approx(2 / 3), "B": pytest.approx(1 / 3), "C": pytest.approx(-1 / 3), "D": pytest.approx(-2 / 3)}
    score = {r["asset"]: r["weight"] for r in pf.portfolio_weights(f, "score").collect()}
    assert score == {"A": 0.5, "B": pytest.approx(1 / 3), "C": pytest.approx(1 / 6), "D": 0.0}


def test_ties_go_by_asset(spark):
    f = factor_table(spark, [(day(0), a, "f", 1.0) for a in "DCBA"])
    got = {r["asset"]: r["weight"] for r in pf.portfolio_weights(f, "score", top_k=1, bottom_k=1).collect()}
    assert got == {"A": 1.0, "D": -1.0}


@pytest.mark.parametrize(("hold", "freq"), [(1, 1), (3, 1), (2, 3), (9, 2)])
def test_overlapping_holdings(spark, hold, freq):
    prices = random_prices(spark, 6, 14)
    returns = forward_return(prices, horizon=1)
    weights = pf.portfolio_weights(forward_return(prices, horizon=2).where(F.dayofmonth("date") > 2), top_k=2, bottom_k=2)
    got = frame(pf.simulate_portfolio_returns(weights, returns, holding_period=hold, rebalance_frequency=freq), "date")
    w, r = frame(weights), frame(returns)
    dates = sorted(w["date"].unique())[::freq]
    sums: dict = {}
    for i, start in enumerate(dates):
        end = dates[i + hold] if i + hold < len(dates) else None
        live = r[(r["date"] >= start) & ((r["date"] < end) if end else True)]
        for d, g in live.merge(w[w["date"] == start][["asset", "weight"]], on="asset").groupby("date"):
            sums.setdefault(d, []).append((g["weight"] * g["value"]).sum())
    assert got["date"].tolist() == sorted(sums)
    np.testing.assert_allclose(got["portfolio_return"], [np.mean(sums[d]) for d in sorted(sums)], atol=1e-12)


def test_turnover_entry_exit_and_return(spark):
    w = table(spark, [(0, "A", 0.5), (0, "B", 0.5), (1, "B", 1.0), (2, "A", 1.0)])
    assert values(pf.portfolio_turnover(w), "date", col="portfolio_turnover") == [None, 0.5, 1.0]
    renamed = w.withColumnRenamed("weight", "target_weight")
    assert values(ex.weight_turnover(renamed), "date", col="turnover") == [0.0, 0.5, 1.0]


def test_costs_only_on_rebalance_dates(spark):
    ret = table(spark, [(0, "x", 0.1), (1, "x", 0.1), (2, "x", 0.1)]).select("date", F.col("weight").alias("portfolio_return"))
    turn = spark.createDataFrame([(day(0), None), (day(2), 0.5)], "date date, portfolio_turnover double")
    assert values(pf.portfolio_cost_adjusted_returns(ret, turn, cost_rate=0.1), "date", col="adjusted_return") == [None, 0.1, pytest.approx(0.05)]


def test_trade_plan_covers_the_grid(spark):
    w = table(spark, [(0, "A", 1.0), (1, "B", 1.0)])
    px = table(spark, [(i, a, 10.0 + i) for i in range(2) for a in "AB"], "close").withColumn("volume", F.lit(3.0))
    got = frame(pf.trade_plan(w, px, portfolio_value=100.0, adv_window=2), "date", "asset")
    assert got["trade_dollar"].tolist() == [100.0, 0.0, -100.0, 100.0]
    assert got["adv_dollar"].tolist() == [30.0, 30.0, 31.5, 31.5]


def build(spark, pc, sig=(4.0, 3.0, 2.0, 1.0), tradable=(True,) * 4):
    keys = [(day(0), a) for a in "ABCD"]
    signal = spark.createDataFrame([(*k, v) for k, v in zip(keys, sig)], "date date, asset string, signal_value double")
    uni = spark.createDataFrame([(*k, True) for k in keys], "date date, asset string, in_universe boolean")
    trd = spark.createDataFrame([(*k, t) for k, t in zip(keys, tradable)], "date date, asset string, is_tradable boolean")
    out = tw.build_target_weights(signal, uni, trd, pc, max_group=4)
    codes = {r["code"] for r in out["warnings"].collect()}
    return [round(v, 10) for v in values(out["target_weights"], "asset", col="target_weight")], codes, out["diagnostics"].first()


def test_target_weights(spark):
    w, codes, diag = build(spark, tw.Construction(top_k=2))
    assert w == [0.5, 0.5, 0.0, 0.0] and not codes and diag["n_positions"] == 2 and diag["gross_exposure"] == 1.0
    w, codes, _ = build(spark, tw.Construction(top_k=2), tradable=(False, True, True, True))
    assert w == [0.0, 0.5, 0.5, 0.0] and not codes
    w, codes, _ = build(spark, tw.Construction(top_k=2, max_weight=0.3))
    assert w == [0.3, 0.3, 0.0, 0.0] and codes == {"max_weight_clipped"}
    w, codes, _ = build(spark, tw.Construction(top_k=3, bottom_k=3, long_short=True, net_limit=0.0))
    assert w == [pytest.approx(1 / 6)] * 3 + [-0.5] and codes == {"insufficient_short_candidates"}
    w, codes, _ = build(spark, tw.Construction(top_k=2, cash_buffer=1.0))
    assert w == [0.0] * 4 and codes == {"non_positive_investable_gross"}
    w, codes, _ = build(spark, tw.Construction(weight_method="score", construction_method="full_universe", long_short=True), sig=(1.0,) * 4)
    assert w == [0.0] * 4 and codes == {"zero_signal_variance"}
    w, codes, _ = build(spark, tw.Construction(top_k=2, net_limit=0.0), tradable=(False,) * 4)
    assert w == [0.0] * 4 and codes == {"no_executable_assets"}
    w, codes, _ = build(spark, tw.Construction(top_k=1, trade_when_not_tradable=True, net_limit=0.0), tradable=(False,) * 4)
    assert w == [1.0, 0.0, 0.0, 0.0] and codes == {"trade_when_not_tradable_enabled", "long_only_net_limit_zero_ignored"}
    w, codes, _ = build(spark, tw.Construction(top_k=4, bottom_k=1, long_short=True))
    assert w == [0.25] * 4 and codes == {"insufficient_short_candidates", "long_short_side_missing"}
    w, codes, _ = build(spark, tw.Construction(top_k=1, bottom_k=1, long_short=True, weight_method="score", net_limit=0.0))
    assert w == [0.5, 0.0, 0.0, -0.5] and not codes


def test_costs(spark):
    rows = [(day(0), "A", 1000.0, 1e6, 0.02), (day(0), "B", 0.0, 1e6, 0.02), (day(0), "C", 500.0, 0.0, 0.02)]
    trades = spark.createDataFrame(rows, "date date, asset string, trade_dollar double, adv_dollar double, daily_volatility double")
    got = frame(fr.cost_per_trade(trades), "asset")
    assert got["cost_flat_fee"][0] == pytest.approx(0.1) and got["cost_spread_proxy"][0] == pytest.approx(0.25)
    assert got["cost_impact_proxy"][0] == pytest.approx(1000 * 0.1 * 0.02 * np.sqrt(1e-3))
    assert np.isinf(got["cost_total"][2]) and got["cost_total_bps"][1:].isna().all()
    assert fr.cost_summary(fr.cost_per_trade(trades)).first()["n_trades"] == 3
    pen = frame(fr.adv_penetration_table(trades), "asset")
    assert np.isinf(pen["adv_participation"][2]) and pen["adv_limit_flag"].tolist() == [False, False, True]


def test_execution_reasons_and_deviation(spark):
    skipped = spark.createDataFrame([(" ST_filter; halted_trading ;st_filter",), ("",), ("odd",), ("odd",)], "s string")
    got = [r["c"] for r in skipped.select(ex.normalize_reason_code(F.col("s")).alias("c")).collect()]
    assert got == ["halted_trading;st_filter", "unclassified", "odd", "odd"]
    dist = frame(ex.reason_distribution(skipped.select(F.col("s").alias("reason_code"), F.lit("x").alias("source_reason"))), "skipped_order_count")
    assert dist["reason_code"].iloc[-1] == "odd" and dist["is_dominant"].tolist() == [False, True]
    t = table(spark, [(0, "A", 0.5), (0, "B", 0.5)], "target_weight")
    e = table(spark, [(0, "A", 0.2), (0, "C", 0.1)], "target_weight")
    dev = ex.execution_deviation(t, e)["summary"].first()
    assert dev["mean_abs_weight_diff"] == pytest.approx(0.3) and dev["max_abs_weight_diff"] == 0.5 and dev["gross_abs_diff_mean"] == pytest.approx(0.7)


def test_performance_summary(spark):
    rows = [("r", day(i), r, e, 0.1) for i, (r, e) in enumerate([(0.1, 1.1), (-0.5, 0.55), (0.2, 0.66)])]
    got = ex.performance_summary(spark.createDataFrame(rows, "run_id string, date date, `return` double, equity double, turnover double")).first()
    assert got["max_drawdown"] == pytest.approx(-0.5) and got["total_return"] == pytest.approx(-0.4) and got["n_periods"] == 3


@pytest.mark.parametrize("moves, drawdown", [([0.5, 0.5, -4.0, 0.5], 0.0), ([-0.5, 0.5, -1.0, 0.5], -1.0)])
def test_equity_after_a_loss_of_all_or_more(spark, monkeypatch, moves, drawdown):
    from panelyard.catalog import registry

    registry.queries()  # imports the catalog in its order
    from panelyard.catalog import execution as catalog

    weights = spark.createDataFrame([(day(i), "A", 1.0) for i in range(4)], "date date, asset string, target_weight double")
    labels = spark.createDataFrame([(day(i), "A", 10 * m) for i, m in enumerate(moves)], "date date, asset string, value double")
    monkeypatch.setattr(catalog, "fwd1", lambda spark, d: labels)
    got = ex.performance_summary(catalog.series(spark, "", weights, "r")).first()
    assert got["max_drawdown"] == pytest.approx(drawdown) and got["n_periods"] == 4
    assert np.isnan(got["total_return"]) if sum(moves) < -2 else got["total_return"] == -1.0
