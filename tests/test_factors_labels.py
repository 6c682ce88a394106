from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import day, frame, panel, random_prices, values
from panelyard.operators import factors, labels


def test_momentum_counts_rows_not_days(spark):
    df = panel(spark, {"A": [100.0, "skip", 110.0, "skip", 121.0]})
    got = values(factors.momentum(df, window=1), "date")
    assert got[0] is None and got[1] == pytest.approx(0.1) and got[2] == pytest.approx(0.1)


def test_momentum_min_periods_and_bad_prices(spark):
    df = panel(spark, {"A": [100.0, None, 120.0, -5.0, 144.0]})
    assert values(factors.momentum(df, window=2), "date") == [None] * 5
    loose = values(factors.momentum(df, window=2, min_periods=2), "date")
    assert loose[2] == pytest.approx(0.2) and loose[4] == pytest.approx(0.2) and loose[3] is None
    with pytest.raises(ValueError):
        factors.momentum(df, window=2, min_periods=4)


def test_momentum_of_levels_that_may_be_zero(spark):
    df = panel(spark, {"A": [1.0, 0.0, 2.0, 0.0, 0.0, None, 3.0]})
    got = values(factors.momentum(df, window=1, min_periods=1, positive=False).where("value is not null and not isnan(value)"), "date")
    assert got == [-1.0, float("inf"), -1.0]
    assert factors.momentum(df, window=1, min_periods=1, positive=False).where("isnan(value)").select("date").collect() == [(day(4),)]
    assert values(factors.momentum(df, window=1, min_periods=1), "date") == [None] * 7


def test_reversal_is_negative_momentum(spark):
    df = random_prices(spark, 3, 12)
    a, b = factors.momentum(df, window=5), factors.reversal(df, window=5)
    both = a.join(b.select("date", "asset", F.col("value").alias("r")), ["date", "asset"]).where("value is not null").toPandas()
    np.testing.assert_allclose(both["value"], -both["r"])
    assert b.first()["factor"] == "reversal_5d"


def test_low_volatility_against_numpy(spark):
    df = random_prices(spark, 2, 15)
    got = frame(factors.low_volatility(df, window=4), "asset", "date")
    close = frame(df, "asset", "date").pivot(index="date", columns="asset", values="close")
    want = -close.pct_change().rolling(4).std()
    for a in want.columns:
        np.testing.assert_allclose(got[got.asset == a]["value"].to_numpy(dtype=float), want[a].to_numpy())


@pytest.mark.parametrize("cut", [10, 17])
def test_factors_do_not_look_ahead(spark, cut):
    df = random_prices(spark, 3, 20)
    early = df.where(F.col("date") < F.lit(day(cut)))
    for fn in (lambda x: factors.momentum(x, window=3), lambda x: factors.low_volatility(x, window=4)):
        whole = frame(fn(df).where(F.col("date") < F.lit(day(cut))), "date", "asset")
        part = frame(fn(early), "date", "asset")
        np.testing.assert_allclose(whole["value"].to_numpy(dtype=float), part["value"].to_numpy(dtype=float))


def test_forward_return_and_event_end(spark):
    df = panel(spark, {"A": [100.0, 110.0, 99.0]})
    assert values(labels.forward_return(df, horizon=1), "date") == [pytest.approx(0.1), pytest.approx(-0.1), None]
    reg = frame(labels.regression_forward_label(df, horizon=2), "date")
    assert reg["event_end"][0] == day(2) and reg["label_value"][0] == pytest.approx(-0.01)


def test_rankpct(spark):
    df = panel(spark, {"A": [1.0, 2.0], "B": [1.0, 3.0], "C": [1.0, 3.0], "D": [1.0, 1.0]})
    got = frame(labels.rankpct_label(df, horizon=1, max_group=4), "date", "asset")
    assert got["label_value"][:4].tolist() == [0.5, 0.875, 0.875, 0.25]
    assert got["confidence"][3] == pytest.approx(0.25)


def test_triple_barrier_hand_checked(spark):
    path = [100.0, 101.0, 100.0, 101.0, 110.0, 111.0, 90.0, 90.0, 90.0]
    got = frame(labels.triple_barrier_labels(panel(spark, {"A": path}), horizon=2, volatility_lookback=3), "date")
    assert got["trigger"][0] == "insufficient_forward_window" and np.isnan(got["label_value"][0])
    assert got["trigger"][3] == "upper_barrier" and got["label_value"][3] == 1.0 and got["realized_horizon"][3] == 1
    assert got["trigger"][5] == "lower_barrier" and got["label_value"][5] == -1.0 and got["event_end"][5] == day(6)
    assert (got["trigger"][-2:] == "insufficient_forward_window").all()


def test_trend_scan_matches_brute_force(spark):
    df = random_prices(spark, 2, 16, seed=5)
    got = frame(labels.trend_scanning_labels(df, min_horizon=2, max_horizon=6), "asset", "date")
    pdf = frame(df, "asset", "date")
    for asset, g in pdf.groupby("asset"):
        y = np.log(g["close"].to_numpy())
        mine = got[got.asset == asset].reset_index(drop=True)
        for i in range(len(y)):
            best = None
            for h in range(2, 7):
                if i + h >= len(y):
                    break
                v, x = y[i : i + h + 1], np.arange(h + 1.0)
                slope, icept = np.polyfit(x, v, 1)
                se = np.sqrt(((v - slope * x - icept) ** 2).sum() / (h - 1) / ((x - x.mean()) ** 2).sum())
                if best is None or abs(slope / se) > abs(best[0]):
                    best = (slope / se, h)
            if best is None:
                assert mine["trigger"][i] == "insufficient_forward_window"
            else:
                assert mine["realized_horizon"][i] == best[1]
                assert mine["confidence"][i] == pytest.approx(abs(best[0]), rel=1e-6)
                assert mine["label_value"][i] == np.sign(best[0])


def test_trend_scan_perfect_fit_has_no_label(spark):
    got = frame(labels.trend_scanning_labels(panel(spark, {"A": [2.0**i for i in range(6)]}), min_horizon=2, max_horizon=3), "date")
    assert got["trigger"][0] == "trend_scan" and np.isnan(got["label_value"][0]) and got["realized_horizon"][0] == 2


def test_label_dispatch_rejects_unknown(spark):
    with pytest.raises(ValueError):
        labels.build_labels(panel(spark, {"A": [1.0, 2.0]}), "nope", horizon=1)
