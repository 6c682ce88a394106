"""Costs, capacity and exposure."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.panels import asset_meta, assets_per_date, cte, fundamentals, mom3, px, sql_with
from panelyard.catalog.portfolio import plan
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.operators import frictions as fr
from panelyard.operators import portfolio as pf
from panelyard.sources.research_inputs import neutralization_exposures

OPTS = dict(flat_fee_bps=1.5, spread_bps=6.0, impact_eta=0.12)


def trades(spark, d):
    return plan(spark, d).where("adv_dollar is not null and daily_volatility is not null")


def cost_ctes(suffix: str, plan_name: str) -> None:
    """CTEs trades<suffix>, tcost<suffix>, pen<suffix> and stress<suffix>."""
    cte(f"trades{suffix}", plan_name, f"SELECT * FROM {plan_name} WHERE adv_dollar IS NOT NULL AND daily_volatility IS NOT NULL")
    cte(
        f"tcost{suffix}", f"trades{suffix}",
        f"""SELECT *, f + s + i AS total, CASE WHEN abs(trade_dollar) > 0 AND isfinite((f + s + i) / abs(trade_dollar)) THEN (f + s + i) / abs(trade_dollar) * 10000 END AS bps FROM (
        SELECT *, abs(trade_dollar) * cast(1.5 as double) * cast(1e-4 as double) AS f, abs(trade_dollar) * cast(6 as double) * cast(1e-4 as double) * cast(0.5 as double) AS s,
        CASE WHEN adv_dollar <= 0 THEN cast('inf' as double) ELSE abs(trade_dollar) * cast(0.12 as double) * daily_volatility * sqrt(abs(trade_dollar) / adv_dollar) END AS i FROM trades{suffix})""",
    )
    cte(f"pen{suffix}", f"trades{suffix}", f"SELECT *, coalesce(abs(trade_dollar) / nullif(adv_dollar, 0), cast('inf' as double)) AS adv_participation FROM trades{suffix}")
    cte(
        f"stress{suffix}", f"pen{suffix}",
        f"""SELECT *, g / cast(1000000 as double) AS turnover, g / cast(1000000 as double) * m AS txl FROM (SELECT date, sum(abs(trade_dollar)) AS g, avg(adv_participation) AS m, quantile_cont(adv_participation, 0.95) AS p95 FROM pen{suffix} GROUP BY date)""",
    )


cost_ctes("", "plan")


@query(
    "trade_costs",
    sql_with("tcost", "SELECT date, asset, round(f, 6) AS cost_flat_fee, round(s, 6) AS cost_spread_proxy, round(i, 6) AS cost_impact_proxy, round(total, 6) AS cost_total, round(bps, 6) AS cost_total_bps FROM tcost"),
)
def _(spark, d):
    out = fr.cost_per_trade(trades(spark, d), **OPTS)
    return rounded(out.select("date", "asset", "cost_flat_fee", "cost_spread_proxy", "cost_impact_proxy", "cost_total", "cost_total_bps"), 6)


@query(
    "trade_costs_by_date",
    sql_with(
        "tcost",
        "SELECT date, round(sum(abs(trade_dollar)), 4) AS gross_trade_dollar, round(sum(total), 4) AS total_cost_dollar, round(avg(bps), 6) AS mean_cost_bps, round(quantile_cont(bps, 0.95), 6) AS p95_cost_bps FROM tcost GROUP BY date",
    ),
)
def _(spark, d):
    out = fr.layered_research_costs(trades(spark, d), max_group=assets_per_date(spark, d), **OPTS)["by_date"]
    return rounded(out, 6, gross_trade_dollar=4, total_cost_dollar=4)


@query("trade_cost_summary", sql_with("tcost", "SELECT count(*) AS n_trades, round(sum(total), 3) AS total_cost_dollar, round(avg(bps), 6) AS mean_cost_bps, round(max(bps), 6) AS max_cost_bps FROM tcost"))
def _(spark, d):
    return rounded(fr.cost_summary(fr.cost_per_trade(trades(spark, d), **OPTS)), 6, total_cost_dollar=3)


LIMIT, WEIGHT, VALUE = 0.05, 0.09, 1000000.0


@query("adv_penetration", sql_with("pen", "SELECT date, asset, round(adv_participation, 8) AS adv_participation, adv_participation > cast(0.05 as double) AS adv_limit_flag FROM pen"))
def _(spark, d):
    out = fr.adv_penetration_table(trades(spark, d), max_adv_participation=LIMIT)
    return rounded(out.select("date", "asset", "adv_participation", "adv_limit_flag"))


@query(
    "turnover_liquidity_stress",
    sql_with("stress", "SELECT date, round(g, 4) AS gross_trade_dollar, round(m, 8) AS mean_adv_participation, round(p95, 8) AS p95_adv_participation, round(turnover, 8) AS turnover, round(txl, 8) AS turnover_x_liquidity FROM stress"),
)
def _(spark, d):
    pen = fr.adv_penetration_table(trades(spark, d), max_adv_participation=LIMIT)
    out = fr.turnover_liquidity_stress(pen, portfolio_value=VALUE, max_group=assets_per_date(spark, d))
    return rounded(out, 8, gross_trade_dollar=4)


# Some assets have no volume, so quantiles meet infinite participations; a tiny range splits every date.
cte(
    "dry", "trades",
    "SELECT date, CASE WHEN cast(asset AS varchar) LIKE '%7' THEN cast('inf' as double) ELSE coalesce(abs(trade_dollar) / nullif(adv_dollar, 0), cast('inf' as double)) END AS p FROM trades",
)


@query(
    "turnover_liquidity_stress_range_split",
    sql_with(
        "dry",
        """SELECT date, round(CASE WHEN l[lo + 1] = l[hi + 1] THEN l[lo + 1] ELSE (hi - spot) * l[lo + 1] + (spot - lo) * l[hi + 1] END, 8) AS p95_adv_participation, n_dry FROM (
        SELECT *, cast(floor(spot) as integer) AS lo, cast(ceil(spot) as integer) AS hi FROM (
        SELECT date, list_sort(list(p)) AS l, (count(*) - 1) * cast(0.95 as double) AS spot, count(*) FILTER (p = 'inf') AS n_dry FROM dry GROUP BY date))""",
    ),
)
def _(spark, d):
    no_volume = F.when(F.col("asset").cast("string").like("%7"), F.lit(0.0)).otherwise(F.col("adv_dollar"))
    pen = fr.adv_penetration_table(trades(spark, d).withColumn("adv_dollar", no_volume), max_adv_participation=LIMIT)
    stress = fr.turnover_liquidity_stress(pen, portfolio_value=VALUE, split_rows=4)
    dry = pen.groupBy("date").agg(F.count_if(F.col("adv_participation") == fr.INF).alias("n_dry"))
    return rounded(stress.select("date", "p95_adv_participation")).join(dry, "date")


@query(
    "concentration_liquidity_flags",
    sql_with("pen", "SELECT date, asset, round(target_weight, 8) AS target_weight, round(adv_participation, 8) AS adv_participation FROM pen WHERE abs(target_weight) >= cast(0.09 as double) AND adv_participation > cast(0.05 as double)"),
)
def _(spark, d):
    pen = fr.adv_penetration_table(trades(spark, d), max_adv_participation=LIMIT)
    out = fr.concentration_liquidity_flags(pen, concentration_weight_threshold=WEIGHT, max_adv_participation=LIMIT)
    return rounded(out.select("date", "asset", "target_weight", "adv_participation"))


@query(
    "capacity_warnings",
    sql_with(
        "pen stress",
        """SELECT count(*) AS n_rows, count(*) FILTER (adv_participation > cast(0.05 as double)) AS n_adv_limit_flags, round(count(*) FILTER (adv_participation > cast(0.05 as double)) / cast(count(*) as double), 8) AS adv_limit_flag_ratio,
        (SELECT round(max(txl), 8) FROM stress) AS max_turnover_x_liquidity, count(*) FILTER (abs(target_weight) >= cast(0.09 as double) AND adv_participation > cast(0.05 as double)) AS n_concentration_liquidity_flags FROM pen""",
    ),
)
def _(spark, d):
    out = fr.run_capacity_diagnostics(
        trades(spark, d), portfolio_value=VALUE, max_adv_participation=LIMIT, concentration_weight_threshold=WEIGHT, max_group=assets_per_date(spark, d)
    )
    return rounded(out["warnings"])


def exposure_ctes(suffix: str, weights: str) -> None:
    cte(f"wx{suffix}", f"{weights} expo", f"SELECT w.date, w.asset, weight, size_exposure, beta_exposure, industry FROM {weights} w LEFT JOIN expo e ON w.date = e.date AND w.asset = e.asset")
    cte(f"ind_x{suffix}", f"wx{suffix}", f"SELECT date, industry, coalesce(sum(weight), 0) AS net_weight FROM wx{suffix} WHERE industry IS NOT NULL GROUP BY 1, 2")
    cte(
        f"sty_x{suffix}", f"wx{suffix}",
        f"SELECT date, 'beta_exposure' AS exposure_name, sum(weight * beta_exposure) AS weighted_exposure FROM wx{suffix} GROUP BY date UNION ALL SELECT date, 'size_exposure', sum(weight * size_exposure) FROM wx{suffix} GROUP BY date",
    )


exposure_ctes("", "w_rank")


def audit(spark, d):
    n = assets_per_date(spark, d)
    expo = neutralization_exposures(px(spark, d), fundamentals(spark, d), asset_meta(spark, d), window=12, min_periods=8, max_group=n)
    weights = pf.portfolio_weights(mom3(spark, d), "rank", top_k=15, bottom_k=10)
    return fr.run_exposure_audit(weights, expo)


@query("industry_exposure", sql_with("ind_x", "SELECT date, industry, round(net_weight, 8) AS net_weight FROM ind_x"))
def _(spark, d):
    return rounded(audit(spark, d)["industry_exposure"])


@query("style_exposure", sql_with("sty_x", "SELECT date, exposure_name, round(weighted_exposure, 6) AS weighted_exposure FROM sty_x"))
def _(spark, d):
    return rounded(audit(spark, d)["style_exposure"], 6)


@query(
    "exposure_summary",
    sql_with(
        "ind_x sty_x",
        """SELECT (SELECT round(max(abs(net_weight)), 7) FROM ind_x) AS max_abs_industry_exposure, (SELECT count(*) FROM ind_x) AS n_industry_cells, (SELECT count(*) FROM sty_x) AS n_style_cells,
        (SELECT round(max(abs(weighted_exposure)), 6) FROM sty_x) AS max_abs_style_exposure""",
    ),
)
def _(spark, d):
    return rounded(audit(spark, d)["summary"], 6, max_abs_industry_exposure=7)
