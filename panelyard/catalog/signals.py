"""Factors and labels on the derived panels."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.panels import (
    asset_meta, assets_per_date, avg_rank_sql, cte, events_iv, fin_ann, fundamentals, fwd_sql, low_vol_sql, momentum_sql, px, px_evt, px_gap, sql_with,
)
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.functions.groups import SPLIT_ROWS
from panelyard.operators import factors, labels
from panelyard.sources import research_inputs as inputs


@query("momentum_signal", sql_with("px_gap", momentum_sql("px_gap", 20)))
def _(spark, d):
    return factors.momentum(px_gap(spark, d), window=20)


@query("momentum_sparse_history", sql_with("px_evt", momentum_sql("px_evt", 5, min_periods=3)))
def _(spark, d):
    return factors.momentum(px_evt(spark, d), window=5, min_periods=3, positive=False)  # a mean event value may be 0


@query("reversal_signal", sql_with("px", momentum_sql("px", 5, "-", "reversal_5d")))
def _(spark, d):
    return factors.reversal(px(spark, d), window=5)


@query("low_volatility_signal", sql_with("px_gap", f"SELECT date, asset, factor, round(value, 8) AS value FROM ({low_vol_sql('px_gap', 20)})"))
def _(spark, d):
    return rounded(factors.low_volatility(px_gap(spark, d), window=20))


@query("size_exposure", sql_with("fundamentals", "SELECT date, asset, round(CASE WHEN total_mv_yuan > 0 THEN ln(total_mv_yuan) END, 8) AS size_exposure FROM fundamentals"))
def _(spark, d):
    return rounded(inputs.size_exposure(fundamentals(spark, d)))


cte(
    "beta", "px",
    """SELECT date, asset, CASE WHEN count(r * m) OVER f >= 8 THEN covar_samp(r, m) OVER f END / nullif(CASE WHEN count(m) OVER f >= 8 THEN var_samp(m) OVER f END, 0) AS beta_exposure
    FROM (SELECT *, avg(r) OVER (PARTITION BY date) AS m FROM (SELECT date, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM px))
    WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
)


@query("rolling_market_beta", sql_with("beta", "SELECT date, asset, round(beta_exposure, 7) AS beta_exposure FROM beta"))
def _(spark, d):
    return rounded(inputs.rolling_market_beta(px(spark, d), window=12, min_periods=8, max_group=assets_per_date(spark, d)), 7)


@query(
    "neutralization_exposures",
    sql_with(
        "beta fundamentals asset_meta",
        """SELECT b.date, b.asset, round(CASE WHEN total_mv_yuan > 0 THEN ln(total_mv_yuan) END, 8) AS size_exposure, round(beta_exposure, 7) AS beta_exposure, industry
        FROM beta b LEFT JOIN fundamentals f ON b.date = f.date AND b.asset = f.asset LEFT JOIN asset_meta a ON b.asset = a.asset""",
    ),
)
def _(spark, d):
    out = inputs.neutralization_exposures(
        px(spark, d), fundamentals(spark, d), asset_meta(spark, d), window=12, min_periods=8, max_group=assets_per_date(spark, d)
    )
    return rounded(out, 8, beta_exposure=7)


@query("book_to_price_signal", sql_with("bp", "SELECT * FROM bp"))
def _(spark, d):
    return inputs.book_to_price(fundamentals(spark, d))


cte(
    "quality", "px fin_ann",
    """SELECT p.date, p.asset, 'quality_profitability_proxy' AS factor, a.q AS value FROM px p ASOF LEFT JOIN (
    SELECT asset, announce_date, coalesce(roe_dt, roe, roa) AS q FROM fin_ann WHERE coalesce(roe_dt, roe, roa) IS NOT NULL) a
    ON p.asset = a.asset AND p.date >= a.announce_date""",
)


@query("point_in_time_quality", sql_with("quality", "SELECT * FROM quality"))
def _(spark, d):
    return inputs.point_in_time_quality(px(spark, d), fin_ann(spark, d))


cte("mom12", "px", momentum_sql("px", 12))


@query("candidate_signal_union", sql_with("mom12 bp quality", "SELECT * FROM mom12 UNION ALL SELECT * FROM bp UNION ALL SELECT * FROM quality"))
def _(spark, d):
    return inputs.candidate_signals(px(spark, d), fundamentals(spark, d), fin_ann(spark, d), window=12)


@query("forward_return_label", sql_with("px_gap", fwd_sql("px_gap", 5)))
def _(spark, d):
    return labels.forward_return(px_gap(spark, d), horizon=5)


_REG = """SELECT date, asset, '{name}' AS label_name, 'regression' AS label_type, lead(close, {h}) OVER w / close - 1 AS label_value, date AS event_start,
 lead(date, {h}) OVER w AS event_end, 'horizon_end' AS trigger, cast({h} as double) AS realized_horizon, cast(null as double) AS confidence
 FROM px WINDOW w AS (PARTITION BY asset ORDER BY date)"""
cte("reg3", "px", _REG.format(name="forward_return_3", h=3))


@query("regression_label", sql_with("reg3", "SELECT * FROM reg3"))
def _(spark, d):
    return labels.regression_forward_label(px(spark, d), horizon=3)


cte(
    "rankpct3", "reg3",
    f"""SELECT r.date, r.asset, 'rankpct_forward_return_3' AS label_name, 'ranking' AS label_type, p AS label_value, event_start, event_end,
    'cross_section_rank' AS trigger, realized_horizon, abs(p - cast(0.5 as double)) AS confidence FROM reg3 r LEFT JOIN (
    SELECT date, asset, {avg_rank_sql('date', 'label_value')} / count(*) OVER (PARTITION BY date) AS p FROM reg3 WHERE label_value IS NOT NULL) k
    ON r.date = k.date AND r.asset = k.asset""",
)


@query("rank_percentile_label", sql_with("rankpct3", "SELECT * FROM rankpct3"))
def _(spark, d):
    return labels.rankpct_label(px(spark, d), horizon=3, max_group=assets_per_date(spark, d))


def _barrier_sql(horizon: int, mult: str, lookback: int) -> str:
    return f"""SELECT k.date, k.asset, 'triple_barrier' AS label_name, 'event_classification' AS label_type,
    CASE WHEN NOT ok THEN NULL WHEN j IS NULL THEN cast(0 as double) WHEN up THEN cast(1 as double) ELSE cast(-1 as double) END AS label_value,
    k.date AS event_start, CASE WHEN ok THEN e.date END AS event_end,
    CASE WHEN NOT ok THEN 'insufficient_forward_window' WHEN j IS NULL THEN 'vertical_barrier' WHEN up THEN 'upper_barrier' ELSE 'lower_barrier' END AS trigger,
    CASE WHEN ok THEN cast(coalesce(j, {horizon}) as double) END AS realized_horizon,
    CASE WHEN ok THEN round(abs(e.close / k.close - 1) / greatest(k.s, cast(1e-12 as double)), 6) END AS confidence
    FROM (SELECT *, coalesce(ahead >= {horizon} AND s > 0, false) AS ok, cl[j] >= hi AS up, {{'date': dl[coalesce(j, {horizon})], 'close': cl[coalesce(j, {horizon})]}} AS e FROM (
      SELECT *, nullif(list_position(list_transform(cl, lambda x: coalesce(x >= hi OR x <= lo, false)), true), 0) AS j FROM (
        SELECT *, list(close) OVER f AS cl, list(date) OVER f AS dl FROM tb WINDOW f AS (PARTITION BY asset ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND {horizon} FOLLOWING)))) k"""


cte(
    "tb", "px_gap",
    """SELECT *, close * (cast(1 as double) + cast(1.5 as double) * s) AS hi, close * (cast(1 as double) - cast(1.5 as double) * s) AS lo FROM (
    SELECT *, CASE WHEN count(r) OVER f >= 2 THEN stddev_pop(r) OVER f END AS s,
    count(*) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ahead FROM (
    SELECT date, asset, close, row_number() OVER w AS rn, close / lag(close) OVER w - 1 AS r FROM px_gap WINDOW w AS (PARTITION BY asset ORDER BY date))
    WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""",
)


@query("triple_barrier_label", sql_with("tb", _barrier_sql(8, "1.5", 10)))
def _(spark, d):
    out = labels.triple_barrier_labels(px_gap(spark, d), horizon=8, pt_mult=1.5, sl_mult=1.5, volatility_lookback=10)
    return rounded(out, 6)


cte(
    "ts_rows", "px",
    "SELECT date, asset, ln(close) AS y, row_number() OVER (PARTITION BY asset ORDER BY date) AS rn FROM px",
)
cte(
    "ts_fit", "ts_rows",
    """SELECT a.date, a.asset, a.rn, h, avg(b.y) AS my, avg(cast(b.rn - a.rn as double)) AS mx, regr_slope(b.y, cast(b.rn - a.rn as double)) AS slope,
    cast(count(*) as double) AS n FROM ts_rows a CROSS JOIN (SELECT unnest(range(2, 11)) AS h) JOIN ts_rows b ON a.asset = b.asset AND b.rn BETWEEN a.rn AND a.rn + h
    GROUP BY 1, 2, 3, 4 HAVING count(*) = h + 1""",
)
cte(
    "ts_stat", "ts_fit ts_rows",
    """SELECT f.date, f.asset, f.rn, f.h, any_value(slope) / sqrt(sum((b.y - my - slope * (b.rn - f.rn - mx)) ** 2) / (any_value(n) - 2) / (any_value(n) * (any_value(n) * any_value(n) - 1) / 12)) AS t
    FROM ts_fit f JOIN ts_rows b ON f.asset = b.asset AND b.rn BETWEEN f.rn AND f.rn + f.h GROUP BY 1, 2, 3, 4""",
)


@query(
    "trend_scanning_label",
    sql_with(
        "ts_stat",
        """SELECT r.date, r.asset, 'trend_scan' AS label_name, 'event_classification' AS label_type, cast(sign(t) as double) AS label_value, r.date AS event_start,
        e.date AS event_end, CASE WHEN s.h IS NULL THEN 'insufficient_forward_window' ELSE 'trend_scan' END AS trigger, cast(s.h as double) AS realized_horizon,
        round(abs(t), 4) AS confidence FROM ts_rows r LEFT JOIN (
        SELECT * FROM ts_stat QUALIFY row_number() OVER (PARTITION BY asset, rn ORDER BY abs(t) DESC, h) = 1) s ON r.asset = s.asset AND r.rn = s.rn
        LEFT JOIN ts_rows e ON e.asset = s.asset AND e.rn = s.rn + s.h""",
    ),
)
def _(spark, d):
    return rounded(labels.trend_scanning_labels(px(spark, d), min_horizon=2, max_horizon=10), 4)


@query("canonical_label", sql_with("reg3", "SELECT date, asset, label_name AS factor, label_value AS value FROM reg3"))
def _(spark, d):
    return labels.labels_to_canonical(labels.build_labels(px(spark, d), "forward_return", horizon=3))


cte("iv3", "reg3", "SELECT date, asset, event_start, greatest(coalesce(event_end, cast(date + cast(realized_horizon as integer) as date)), event_start) AS event_end FROM reg3")


@query("label_interval_samples", sql_with("iv3", "SELECT * FROM iv3"))
def _(spark, d):
    return labels.interval_samples(labels.regression_forward_label(px(spark, d), horizon=3), fallback_horizon=3)
