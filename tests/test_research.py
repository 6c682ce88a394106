from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import day, factor_table, frame, random_prices
from panelyard.operators import composite as cp
from panelyard.operators import evaluation as ev
from panelyard.operators import screening as sc
from panelyard.operators import verdicts as vd
from panelyard.operators.factors import momentum, reversal
from panelyard.operators.labels import forward_return
from panelyard.plans import workflows as wk
from panelyard.plans.experiment import run_factor_experiment
from panelyard.plans.walk_forward import run_walk_forward_experiment


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(123)
    rows, labels = [], []
    for k in range(20):
        y = rng.normal(size=25)
        f1 = y + rng.normal(0, 1.0, 25)
        f2 = f1 + rng.normal(0, 0.05, 25)
        f3 = rng.normal(size=25)
        for i in range(25):
            labels.append((day(k), f"a{i:02d}", "y", float(y[i])))
            for name, v in (("f1", f1), ("f2", f2), ("f3", f3)):
                rows.append((day(k), f"a{i:02d}", name, None if name == "f3" and i % 2 else float(v[i])))
    return factor_table(spark, rows), factor_table(spark, labels)


def wide(df):
    return frame(df).pivot(index=["date", "asset"], columns="factor", values="value")


def test_redundancy_and_vif(pool):
    f, y = pool
    w = wide(f)
    pairs = {(r["factor_a"], r["factor_b"]): r["corr"] for r in sc.pairwise_redundancy(f)["pairs"].collect()}
    for (a, b), c in pairs.items():
        assert c == pytest.approx(w[a].corr(w[b]))
    full = w.dropna()
    for r in sc.vif_diagnostics(f).collect():
        x = np.column_stack([np.ones(len(full)), full.drop(columns=r["factor"])])
        v = full[r["factor"]]
        res = v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
        assert r["vif"] == pytest.approx(1 / (res.var(ddof=0) / v.var(ddof=0)), rel=1e-8)


def test_screening_decisions(pool):
    f, y = pool
    got = {r["factor"]: r["decision"] for r in sc.screen_factors(f, y, max_group=75)["decisions"].collect()}
    assert got == {"f1": "redundant_factor", "f2": "redundant_factor", "f3": "weak_factor"}


def test_marginal_ic(pool):
    f, y = pool
    w = wide(f)
    z = w.groupby(level="date").transform(lambda v: (v - v.mean()) / v.std(ddof=0))
    target = wide(y)["y"]

    got = sc.marginal_ic_contribution(f, y, max_group=25).toPandas().set_index("factor")

    def pooled(cols):
        c = z[cols].mean(axis=1)
        both = pd.DataFrame({"c": c, "y": target}).dropna()
        return np.mean([g["c"].rank().corr(g["y"].rank()) for _, g in both.groupby(level="date")])

    for name in w.columns:
        assert got.loc[name, "pool_rank_ic_full"] == pytest.approx(pooled(list(w.columns)))
        assert got.loc[name, "pool_rank_ic_without_factor"] == pytest.approx(pooled([c for c in w.columns if c != name]))


def test_student_t_tail(spark):
    """Closed forms for 1 and 2 degrees of freedom, integration of the density for the rest."""

    def tail(t, df):
        if df == 1:
            return 1 - 2 / np.pi * np.arctan(t)
        if df == 2:
            return 1 - t / np.sqrt(2 + t * t)
        x = np.linspace(0, 60, 2_000_001)
        dens = np.exp(-(df + 1) / 2 * np.log1p(x * x / df))
        area = np.concatenate([[0.0], np.cumsum((dens[1:] + dens[:-1]) / 2)])
        return 1 - np.interp(t, x, area) / area[-1]

    cases = [(0.0, 1.0), (1.0, 1.0), (12.7, 1.0), (0.5, 2.0), (30.0, 2.0), (2.0, 10.0), (5.0, 200.0), (1.96, 5000.0), (0.1, 77.0)]
    df = spark.createDataFrame(cases, "t double, n double")
    for r in df.withColumn("got", sc.student_t_two_sided()(F.col("t"), F.col("n"))).collect():
        assert r["got"] == pytest.approx(tail(r["t"], r["n"]), rel=1e-5, abs=1e-12)


def test_adjusted_pvalues(spark):
    df = spark.createDataFrame([(0.01,), (0.04,), (0.5,)], "p_value double")
    got = frame(sc.adjust_pvalues(df), "p_value")
    assert got["mt_adjusted_pvalue"].tolist() == pytest.approx([0.03, 0.12, 1.0]) and got["mt_reject"].tolist() == [True, False, False]
    sidak = frame(sc.adjust_pvalues(df, method="sidak", n_tests=2), "p_value")
    assert sidak["mt_adjusted_alpha"][0] == pytest.approx(sc.sidak_threshold(0.05, 2)) and sc.bonferroni_threshold(0.05, 5) == pytest.approx(0.01)


def test_clusters_follow_chains(spark):
    rows = [("a", "b", 0.9), ("b", "c", -0.85), ("a", "c", 0.1), ("a", "d", 0.2), ("d", "e", 0.95), ("c", "z", 0.8), ("e", "z", 0.0)]
    pairs = spark.createDataFrame(rows, "alpha_a string, alpha_b string, corr double")
    got = {r["members"] for r in cp.cluster_summary(cp.correlation_clusters(pairs, threshold=0.8)).collect()}
    assert got == {"a|b|c|z", "d|e"}


def test_effective_count_matches_eigenvalues(pool):
    corr = wide(pool[0]).dropna().corr()
    pairs = sc.pairwise_correlation(pool[0].join(pool[0].where("factor = 'f3' and value is not null").select("date", "asset"), ["date", "asset"]))
    eig = np.linalg.eigvalsh(corr)
    assert sc.effective_trial_count(pairs).first()["effective_trial_count"] == pytest.approx(eig.sum() ** 2 / (eig**2).sum())


@pytest.mark.parametrize("method", ["equal", "ic", "icir"])
def test_composite_weights(pool, method):
    f, y = pool
    out = cp.compose_signals(f, method=method, labels=y, lookback=6, min_history=3, max_group=75)
    w = frame(out["weights"], "date", "factor").pivot(index="date", columns="factor", values="weight")
    assert np.allclose(w.sum(axis=1), 1.0) and (w >= 0).all().all()
    if method != "equal":
        ic = frame(cp.ic_history(f, y, max_group=75), "date", "factor").pivot(index="date", columns="factor", values="rank_ic")
        past = ic.rolling(6, min_periods=3).mean() if method == "ic" else ic.rolling(6, min_periods=3).mean() / ic.rolling(6, min_periods=3).std()
        score = past.shift(1).clip(lower=0)
        want = score.div(score.sum(axis=1), axis=0).fillna(1 / 3)
        np.testing.assert_allclose(w.to_numpy(), want.to_numpy())
    z = wide(f).groupby(level="date").transform(lambda v: (v - v.mean()) / v.std(ddof=0))
    spread = w.reindex(z.index.get_level_values("date")).to_numpy()
    want = (z * spread).sum(axis=1) / np.where(z.notna(), spread, 0).sum(axis=1)
    got = frame(out["composite"], "date", "asset")
    np.testing.assert_allclose(got["value"].astype(float), want.to_numpy(), atol=1e-12)


def test_composite_weights_ignore_the_future(pool):
    f, y = pool
    cut = F.col("date") <= F.lit(day(12))
    whole = frame(cp.composite_weights(f, method="ic", labels=y, max_group=75).where(cut), "date", "factor")
    part = frame(cp.composite_weights(f.where(cut), method="ic", labels=y.where(cut), max_group=75), "date", "factor")
    np.testing.assert_allclose(whole["weight"], part["weight"])


def test_walk_forward_equals_a_loop_over_folds(spark):
    prices = random_prices(spark, 10, 24)
    fn = lambda p: momentum(p, window=2)
    wf = run_walk_forward_experiment(prices, fn, train_size=8, test_size=5, step=4, horizon=2, cost_rate=0.001, max_group=10)
    got = frame(wf["fold_summary"], "fold_id")
    for r in got.itertuples():
        cut = prices.where(F.col("date") <= F.lit(r.end_date))
        one = run_factor_experiment(cut, fn, horizon=2, train_end=str(r.train_end), test_start=str(r.start_date), max_group=10)["summary"].first()
        for mine, theirs in (("mean_ic", "mean_ic"), ("mean_rank_ic", "mean_rank_ic"), ("mean_long_short", "mean_long_short_return"), ("mean_turnover", "mean_long_short_turnover")):
            assert getattr(r, mine) == pytest.approx(one[theirs])
    agg = wf["aggregate"].first()
    assert agg["n_folds"] == len(got) and agg["best_fold"] == got.loc[got["mean_ic"].idxmax(), "fold_id"]


def test_decay_profile_equals_single_horizons(spark):
    prices = random_prices(spark, 8, 20)
    f = momentum(prices, window=2)
    got = {r["horizon"]: r["mean_rank_ic"] for r in ev.signal_decay_profile(f, prices, horizons=(1, 4), max_group=8).collect()}
    for h, v in got.items():
        assert v == pytest.approx(ev.compute_rank_ic(f, forward_return(prices, horizon=h), max_group=8).agg(F.avg("rank_ic")).first()[0])


def test_cadence(spark):
    df = spark.createDataFrame([(None, 0.0), (5.0, 5.0), (2.0, 5.0), (500.0, 0.0)], "half_life_periods double, t double")
    got = vd.recommend_rebalance_cadence(df, turnover_col="t").toPandas()
    assert got["cadence_periods"].tolist() == [5, 2, 1, 63] and got["cadence_label"].tolist() == ["weekly", "daily_or_2day", "daily_or_2day", "slow_monthly_plus"]
    assert got["warnings"][2].split("|") == ["high_turnover_and_fast_cadence_execution_risk", "signal_half_life_is_very_short", "turnover_is_high_consider_trade_buffer"]


def test_workflows_reach_a_verdict(spark):
    prices = random_prices(spark, 12, 40).withColumns({"volume": F.lit(1e5), "dollar_volume": F.col("close") * 1e5})
    meta = prices.select("asset").distinct().withColumns({"listing_date": F.lit("2020-01-01").cast("date"), "is_st": F.lit(False)})
    single = wk.run_single_factor_workflow(prices, wk.SingleFactorSpec(factor_fn=lambda p: reversal(p, window=2)), asset_metadata=meta, max_group=12)
    assert single["verdict"].first()["verdict"] in {"reject", "needs_review", "candidate_for_registry", "candidate_for_external_backtest"}
    spec = wk.CompositeSpec(composite_lookback=10, portfolio=wk.pf.Strategy(long_top_k=3, short_bottom_k=3))
    fns = {"m2": lambda p: momentum(p, window=2), "m5": lambda p: momentum(p, window=5)}
    both = wk.run_composite_workflow(prices, spec, factor_fns=fns, asset_metadata=meta, max_group=24)
    assert "exposure_diagnostics_missing" in both["verdict"].first()["warnings"]
