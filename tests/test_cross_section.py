from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day, factor_table, frame, panel, random_prices, values
from panelyard.operators import evaluation as ev
from panelyard.operators import neutralization as nz
from panelyard.operators import transforms as tr
from panelyard.operators.labels import forward_return
from panelyard.operators.universe import UniverseRules, construct_research_universe


def cross(spark, numbers, n_dates=1):
    return factor_table(spark, [(day(k), f"a{i:02d}", "f", v) for k in range(n_dates) for i, v in enumerate(numbers)])


@pytest.mark.parametrize("max_group", [None, 100])
def test_transforms_on_degenerate_groups(spark, max_group):
    flat = cross(spark, [2.0, 2.0, None])
    assert values(tr.zscore_cross_section(flat, min_group_size=2, max_group=max_group), "asset") == [0.0, 0.0, 0.0]
    assert values(tr.zscore_cross_section(flat, min_group_size=3, max_group=max_group), "asset") == [None] * 3
    assert values(tr.rank_cross_section(cross(spark, [5.0, 5.0, 1.0, None]), max_group=max_group), "asset") == pytest.approx([5 / 6, 5 / 6, 1 / 3, None])
    clipped = values(tr.winsorize_cross_section(cross(spark, [0.0, 1.0, 2.0, 100.0]), lower=0.25, upper=0.75, max_group=max_group), "asset")
    assert clipped == pytest.approx([0.75, 1.0, 2.0, 26.5])
    assert tr.apply_min_coverage_gate(cross(spark, [1.0, None, None, None]), min_coverage=0.5, max_group=max_group).count() == 0


def test_whole_column_transforms(spark):
    df = cross(spark, [float(i) for i in range(101)])
    assert max(values(tr.winsorize_series(df, lower=0.1, upper=0.9))) == 90.0
    z = values(tr.zscore_series(df))
    assert np.mean(z) == pytest.approx(0.0) and np.std(z) == pytest.approx(1.0)


def test_universe_mask_treats_absent_keys_as_outside(spark):
    df = cross(spark, [1.0, 2.0, 3.0])
    mask = spark.createDataFrame([(day(0), "a00", True), (day(0), "a01", False)], "date date, asset string, in_universe boolean")
    assert values(tr.apply_universe_mask(df, mask), "asset") == [1.0, None, None]


def test_quantiles_pin_both_ends_and_round_half_up(spark):
    got = values(ev.quantile_assignments(cross(spark, [float(i) for i in range(10)]), 5, max_group=10), "asset", col="quantile")
    want = [int((r - 1) / 9 * 4 + 1 + 0.5) for r in range(1, 11)]
    assert got == want and got[0] == 1 and got[-1] == 5
    assert values(ev.quantile_assignments(cross(spark, [3.0, 3.0]), 5), "asset", col="quantile") == [1, 1]
    assert ev.quantile_assignments(cross(spark, [3.0]), 5).count() == 0


def test_turnover_uses_previous_panel_date(spark):
    rows = [(0, "A", 1), (0, "B", 2), (1, "B", 2), (2, "A", 1), (2, "B", 1)]
    df = spark.createDataFrame([(day(i), a, "f", q) for i, a, q in rows], "date date, asset string, factor string, quantile int")
    got = {(r["date"], r["quantile"]): r["turnover"] for r in ev.quantile_turnover(df).collect()}
    assert got[(day(0), 1)] is None and got[(day(1), 2)] == 0.0
    assert got[(day(2), 1)] == 1.0  # A skipped the previous date, B changed bucket


def test_ic_edges(spark):
    f, y = cross(spark, [1.0, 2.0, 3.0], 2), cross(spark, [3.0, 2.0, 1.0])
    y = y.unionByName(factor_table(spark, [(day(1), "a00", "f", 1.0), (day(1), "a01", "f", None), (day(1), "a02", "f", None)]))
    got = frame(ev.compute_ic(f, y), "date")
    assert got["ic"][0] == pytest.approx(-1.0) and np.isnan(got["ic"][1])


def test_rank_ic_is_invariant_to_monotone_maps(spark):
    prices = random_prices(spark, 12, 10)
    y = forward_return(prices, horizon=1)
    f = y.withColumn("value", F.exp(F.col("value") * 5)).withColumn("factor", F.lit("g"))
    got = [v for v in values(ev.compute_rank_ic(f, y, max_group=12), "date", col="rank_ic") if v is not None]
    assert got and all(v == pytest.approx(1.0) for v in got)


def test_monotonicity_and_long_short(spark):
    rows = [(day(0), "f", 1, -0.1), (day(0), "f", 2, 0.0), (day(0), "f", 3, 0.2), (day(1), "f", 1, 0.1), (day(1), "f", 2, 0.0), (day(1), "f", 3, 0.2), (day(2), "f", 2, 0.5)]
    df = spark.createDataFrame(rows, "date date, factor string, quantile int, mean_return double")
    mono = frame(ev.quantile_monotonicity(df), "date")
    assert mono["is_monotonic"].tolist() == [True, False, False] and mono["rank_corr_quantile_return"][0] == pytest.approx(1.0)
    ls = values(ev.long_short_return(df), "date", col="long_short_return")
    assert ls == [pytest.approx(0.3), pytest.approx(0.1), None]


def test_half_life(spark):
    rows = [("f", h, 0.1 * 0.5 ** (h / 4)) for h in (1, 2, 5, 10)] + [("up", 1, 0.1), ("up", 5, 0.2), ("one", 1, 0.3)]
    got = {r["factor"]: r["half_life_periods"] for r in ev.estimate_half_life(spark.createDataFrame(rows, "factor string, horizon int, mean_rank_ic double")).collect()}
    assert got["f"] == pytest.approx(4.0) and got["up"] is None and got["one"] is None


@pytest.fixture(scope="module")
def exposed(spark):
    rng = np.random.default_rng(42)
    rows = []
    for k in range(4):
        for i in range(40):
            s, b, ind = rng.normal(), rng.normal(), None if i % 13 == 0 else "ABC"[i % 3]
            y = 1.5 * s + 0.8 * b + {"A": 0.0, "B": 1.0, "C": -1.0, None: 0.0}[ind] + rng.normal(0, 0.1)
            rows.append((day(k), f"a{i:02d}", None if i == 7 else float(y), float(s), None if i == 9 else float(b), ind))
    return spark.createDataFrame(rows, "date date, asset string, value double, size double, beta double, industry string")


@pytest.mark.parametrize("solver", ["closed_form", "ridge"])
def test_neutralization_matches_least_squares(spark, exposed, solver):
    out = nz.neutralize_signal(exposed, size_col="size", beta_col="beta", industry_col="industry", solver=solver)
    got = frame(out["data"], "date", "asset")
    pdf = frame(exposed, "date", "asset")
    for d, g in pdf.groupby("date"):
        ok = g[["value", "size", "beta"]].notna().all(axis=1)
        x = np.column_stack([np.ones(ok.sum()), g["size"][ok], g["beta"][ok], g["industry"][ok] == "B", g["industry"][ok] == "C"]).astype(float)
        beta = np.linalg.solve(x.T @ x + 1e-8 * np.eye(5), x.T @ g["value"][ok].to_numpy())
        np.testing.assert_allclose(got.loc[g.index[ok], "value_neutralized"], g["value"][ok] - x @ beta, atol=1e-6)
        assert got.loc[g.index[~ok], "value_neutralized"].isna().all()
        coef = out["coefficients"].where(F.col("date") == F.lit(d)).toPandas().set_index("exposure")["coefficient"]
        np.testing.assert_allclose(coef[["intercept", "size_exposure", "beta_exposure", "industry_B", "industry_C"]], beta, atol=1e-6)
    diag = out["diagnostics"].toPandas().set_index("exposure")
    assert diag.loc["size_exposure", "mean_abs_corr_before"] > 0.5 and diag.loc["size_exposure", "mean_abs_corr_after"] < 1e-6
    assert diag.loc["industry_B", "n_dates_used"] == 4


def test_neutralization_without_baseline_or_with_collinear_exposures(spark, exposed):
    # The baseline industry exists elsewhere only; both exposures are the same column.
    no_base = exposed.where((F.col("date") != F.lit(day(0))) | F.col("industry").isin("B", "C"))
    out = nz.neutralize_signal(no_base, size_col="size", beta_col="size", industry_col="industry", min_obs=5)["data"]
    assert out.where((F.col("date") == F.lit(day(0))) & F.col("value_neutralized").isNotNull()).count() > 20
    few = nz.neutralize_signal(exposed, size_col="size", min_obs=1000)
    assert few["data"].where("value_neutralized is not null").count() == 0 and few["coefficients"].count() == 0


def test_universe_precedence(spark):
    prices = panel(spark, {a: [10.0] for a in "ABCDE"}).withColumn("volume", F.lit(100.0))
    meta = spark.createDataFrame(
        [(a, day(-400), a == "B") for a in "ABCD"], "asset string, listing_date date, is_st boolean"
    )
    state = spark.createDataFrame([(day(0), "C", True, True), (day(0), "D", False, True)], "date date, asset string, is_halted boolean, is_limit_locked boolean")
    out = construct_research_universe(prices, asset_metadata=meta, market_state=state, rules=UniverseRules(min_adv=1e9))
    reasons = {(r["asset"], r["reason"]) for r in out["exclusion_reasons"].collect()}
    assert reasons == {
        ("A", "min_adv_filter"), ("B", "st_filter"), ("C", "halted_trading"), ("D", "limit_locked_non_executable"), ("E", "listing_age_or_missing_listing_date"),
    }
    assert out["diagnostics"].first()["n_in_universe"] == 3 and out["tradability"].where("is_tradable").count() == 0
