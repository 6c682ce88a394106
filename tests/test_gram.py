"""Moments of many series against pandas and plain least squares."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from helpers import day, factor_table

from panelyard.operators import gram
from panelyard.operators import screening as sc


def long_rows(x, names=None):
    names = names or [f"f{j:02d}" for j in range(x.shape[1])]
    return [(day(i // 20), f"a{i % 20:02d}", n, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for n, v in zip(names, row, strict=True)]


def block(n=400, k=40, seed=2, missing=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, k)) @ rng.normal(0, 1, (k, k)) * 0.01 + rng.normal(0, 1000, k)
    x[rng.random((n, k)) < missing] = np.nan
    return x


@pytest.mark.parametrize("columns", [gram.COLUMNS, 7])
def test_forty_factors_equal_pairwise_complete_correlations(spark, columns):
    x = block()
    x[:, 5] = np.where(np.isnan(x[:, 5]), np.nan, 3.7)  # constant
    x[:, 6] = np.nan  # no value
    x[:200, 7], x[200:, 8] = np.nan, np.nan  # no common key
    x[:, 9] = np.where(np.arange(400) < 390, np.where(np.isnan(x[:, 9]), np.nan, 5.1), x[:, 9])
    x[390:, 10] = np.nan  # the pair of 9 and 10 is constant in 9, though 9 varies
    values = factor_table(spark, long_rows(x))
    found = {(r["a"], r["b"]): r["corr"] for r in gram_correlations(values, columns).collect()}
    want = pd.DataFrame(x, columns=[f"f{j:02d}" for j in range(40)]).corr(min_periods=2)
    assert len(found) == 40 * 39 // 2 and found["f07", "f08"] is found["f09", "f10"] is found["f05", "f20"] is found["f06", "f20"] is None
    for (a, b), c in found.items():
        if np.isnan(want.loc[a, b]):
            assert c is None
        else:
            assert c == pytest.approx(want.loc[a, b], abs=1e-9)


def gram_correlations(values, columns):
    held, gram.COLUMNS = gram.COLUMNS, columns
    try:
        if columns == held:
            return sc.pairwise_correlation(values)
        named = gram.series_means(values, "factor")
        sums = gram.pair_sums(gram.key_arrays(values, ("date", "asset"), "factor", [n for n, _ in named]), [m for _, m in named], columns)
        whole = gram.pair_sums(gram.key_arrays(values, ("date", "asset"), "factor", [n for n, _ in named]), [m for _, m in named])
        a, b = (sorted(map(tuple, s.collect())) for s in (sums, whole))
        assert len(a) == len(b) == 780 and np.allclose(np.array(a, float), np.array(b, float), rtol=1e-9, atol=1e-6)
        return sc.pairwise_correlation(values)
    finally:
        gram.COLUMNS = held


def test_plan_has_no_row_per_pair_and_key(spark):
    values = factor_table(spark, long_rows(block(60, 6)))
    named = gram.series_means(values, "factor")
    plan = gram.pair_sums(gram.key_arrays(values, ("date", "asset"), "factor", [n for n, _ in named]), [m for _, m in named])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


def test_repeated_keys_raise(spark):
    rows = long_rows(block(20, 3, missing=0))
    with pytest.raises(Exception, match="more than one value"):
        sc.pairwise_correlation(factor_table(spark, rows + rows[:1])).collect()


def plain_vif(x):
    out = []
    for i in range(x.shape[1]):
        y, others = x[:, i], np.column_stack([np.ones(len(x)), np.delete(x, i, axis=1)])
        fit = others @ np.linalg.lstsq(others, y, rcond=None)[0]
        total = ((y - y.mean()) ** 2).sum()
        r2 = 1 - ((y - fit) ** 2).sum() / total if total > 0 else np.nan
        out.append(None if np.isnan(r2) else np.inf if r2 >= 0.999999 else 1 / (1 - r2))
    return out


def test_inflation_of_many_factors(spark):
    x = block(300, 12, seed=6, missing=0)
    x[:, 3] = x[:, 1] - 2 * x[:, 2]
    x[:, 7] = 4.25
    found = {r["factor"]: r["vif"] for r in sc.vif_diagnostics(factor_table(spark, long_rows(x))).collect()}
    for i, want in enumerate(plain_vif(x)):
        got = found[f"f{i:02d}"]
        assert got == want if want in (None, np.inf) else got == pytest.approx(want, rel=1e-6)
    assert found["f01"] == found["f02"] == found["f03"] == np.inf and found["f07"] is None


def test_inflation_bounds(spark, monkeypatch):
    x = block(30, 4, missing=0)
    few = sc.vif_diagnostics(factor_table(spark, long_rows(x[:4]))).collect()
    assert len(few) == 4 and all(r["vif"] is None for r in few)
    assert [r["vif"] for r in sc.vif_diagnostics(factor_table(spark, long_rows(x[:, :1]))).collect()] == [1.0]
    assert sc.vif_diagnostics(factor_table(spark, [(day(0), "a", "f", None)]).where("false")).collect() == []
    monkeypatch.setattr(sc, "MAX_FACTORS", 3)
    with pytest.raises(ValueError, match="more than 3"):
        sc.vif_diagnostics(factor_table(spark, long_rows(x)))


def plain_marginal(x, y, dates):
    """Mean rank IC of the pool and of the pools without one factor."""
    z = pd.DataFrame(x)
    z = z.groupby(dates).transform(lambda s: (s - s.mean()) / s.std(ddof=0) if s.nunique() > 1 else s * 0 if s.notna().all() else pd.Series(0.0, s.index))

    def ic(pool):
        both = [pd.DataFrame({"p": pool[dates == d], "y": y[dates == d]}).dropna().rank() for d in np.unique(dates)]
        return float(np.nanmean([b["p"].corr(b["y"]) for b in both]))

    full = ic(z.mean(axis=1))
    return full, [ic(z.drop(columns=c).mean(axis=1)) for c in z]


@pytest.mark.parametrize("bound", [20, None])
def test_marginal_contribution_on_both_paths(spark, bound):
    rng = np.random.default_rng(8)
    x = np.round(block(200, 5, seed=8, missing=0.2), 3)
    x[:20, 2] = 1.5  # constant on a date
    x[20:40, 3] = np.nan  # missing on a date
    y = pd.Series(np.where(rng.random(200) < 0.1, np.nan, rng.normal(0, 1, 200)))
    dates = np.arange(200) // 20
    labels = [(day(i // 20), f"a{i % 20:02d}", "fwd", None if np.isnan(v) else float(v)) for i, v in enumerate(y)] + [(day(0), "zz", "fwd", 1.0)]
    rows = {r["factor"]: r for r in sc.marginal_ic_contribution(factor_table(spark, long_rows(x)), factor_table(spark, labels), max_group=bound).collect()}
    full, without = plain_marginal(x, y, dates)
    for i, w in enumerate(without):
        r = rows[f"f{i:02d}"]
        assert (r["pool_rank_ic_full"], r["pool_rank_ic_without_factor"], r["marginal_delta"]) == pytest.approx((full, w, full - w), abs=1e-9)


def test_marginal_contribution_moves_the_panel_once(spark):
    x = block(60, 4, missing=0)
    labels = factor_table(spark, [(day(i // 20), f"a{i % 20:02d}", "fwd", float(i % 7)) for i in range(60)])
    ic = sc._pool_ic_by_date(factor_table(spark, long_rows(x)), labels, [f"f{j:02d}" for j in range(4)])
    plan = ic._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Generate" not in plan and ic.count() == 3 * 5


def test_single_factor_has_no_marginal(spark):
    one = factor_table(spark, long_rows(block(40, 1, missing=0)))
    rows = sc.marginal_ic_contribution(one, one, max_group=20).collect()
    assert [tuple(r) for r in rows] == [("f00", None, None, None)]
