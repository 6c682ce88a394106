"""Trading costs, capacity and exposure of weight and trade tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, ratio
from panelyard.functions.groups import attach, group_quantiles
from panelyard.sources.contracts import require_rules

BPS = 1e-4
INF = float("inf")


def flat_fee_cost(trade: Column, *, fee_bps: float) -> Column:
    if fee_bps < 0:
        raise ValueError("fee_bps must be >= 0")
    return F.abs(trade) * F.lit(float(fee_bps)) * F.lit(BPS)


def spread_proxy_cost(trade: Column, *, spread_bps: float) -> Column:
    """Half the quoted spread."""
    if spread_bps < 0:
        raise ValueError("spread_bps must be >= 0")
    return F.abs(trade) * F.lit(float(spread_bps)) * F.lit(BPS) * F.lit(0.5)


def sqrt_impact_cost(trade: Column, *, adv_dollar: Column, daily_volatility: Column, eta: float = 0.1) -> Column:
    """eta x volatility x sqrt(participation); infinite where there is no volume."""
    if eta < 0:
        raise ValueError("eta must be >= 0")
    rate = F.lit(float(eta)) * daily_volatility * F.sqrt(F.try_divide(F.abs(trade), adv_dollar))
    return F.when(adv_dollar <= 0, F.lit(INF)).otherwise(F.abs(trade) * rate)


def cost_rules(trade_col: str = "trade_dollar", adv_col: str = "adv_dollar", vol_col: str = "daily_volatility") -> dict[str, Column]:
    """What makes a trade's cost unknown or meaningless."""
    return {
        "missing_trade": clean(trade_col).isNull(),
        "missing_adv": clean(adv_col).isNull(),
        "negative_adv": clean(adv_col) < 0,
        "missing_volatility": clean(vol_col).isNull(),
        "negative_volatility": clean(vol_col) < 0,
    }


def cost_per_trade(
    trades: DataFrame, *, flat_fee_bps: float = 1.0, spread_bps: float = 5.0, impact_eta: float = 0.1,
    trade_col: str = "trade_dollar", adv_col: str = "adv_dollar", vol_col: str = "daily_volatility", validate: bool = True,
) -> DataFrame:
    """Costs of each trade. Missing inputs, negative volume or volatility raise unless ``validate`` is off."""
    if validate:
        require_rules(trades, cost_rules(trade_col, adv_col, vol_col), "trades")
    trade = clean(trade_col)
    out = trades.withColumns(
        {
            "cost_flat_fee": flat_fee_cost(trade, fee_bps=flat_fee_bps),
            "cost_spread_proxy": spread_proxy_cost(trade, spread_bps=spread_bps),
            "cost_impact_proxy": sqrt_impact_cost(trade, adv_dollar=clean(adv_col), daily_volatility=clean(vol_col), eta=impact_eta),
        }
    )
    out = out.withColumn("cost_total", F.col("cost_flat_fee") + F.col("cost_spread_proxy") + F.col("cost_impact_proxy"))
    bps = F.try_divide(F.col("cost_total"), F.abs(trade)) * F.lit(10000.0)
    return out.withColumn("cost_total_bps", F.when(bps < F.lit(INF), bps))


def costs_by_date(per_trade: DataFrame, *, trade_col: str = "trade_dollar", max_group: int | None = None) -> DataFrame:
    totals = per_trade.groupBy("date").agg(
        F.sum(F.abs(clean(trade_col))).alias("gross_trade_dollar"),
        F.sum("cost_total").alias("total_cost_dollar"),
        F.avg("cost_total_bps").alias("mean_cost_bps"),
    )
    p95 = group_quantiles(per_trade, ["date"], F.col("cost_total_bps"), (0.95,), ("p95_cost_bps",), max_group=max_group)
    return attach(totals, p95, ["date"])


def cost_summary(per_trade: DataFrame) -> DataFrame:
    return per_trade.agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.coalesce(F.sum("cost_total"), F.lit(0.0)).alias("total_cost_dollar"),
        F.avg("cost_total_bps").alias("mean_cost_bps"),
        F.max("cost_total_bps").alias("max_cost_bps"),
    )


def layered_research_costs(trades: DataFrame, *, max_group: int | None = None, **options) -> dict[str, DataFrame]:
    per_trade = cost_per_trade(trades, **options)
    by_date = costs_by_date(per_trade, trade_col=options.get("trade_col", "trade_dollar"), max_group=max_group)
    return {"per_trade": per_trade, "by_date": by_date, "summary": cost_summary(per_trade)}


def adv_penetration_table(trades: DataFrame, *, max_adv_participation: float = 0.05) -> DataFrame:
    """Share of ADV per trade (infinite without volume) and whether it exceeds the limit."""
    if max_adv_participation <= 0:
        raise ValueError("max_adv_participation must be > 0")
    part = F.coalesce(ratio(F.abs(clean("trade_dollar")), clean("adv_dollar")), F.lit(INF))
    return trades.withColumn("adv_participation", part).withColumn(
        "adv_limit_flag", F.col("adv_participation") > F.lit(float(max_adv_participation))
    )


def turnover_liquidity_stress(penetration: DataFrame, *, portfolio_value: float, max_group: int | None = None, split_rows: int | None = None) -> DataFrame:
    if portfolio_value <= 0:
        raise ValueError("portfolio_value must be > 0")
    totals = penetration.groupBy("date").agg(
        F.sum(F.abs("trade_dollar")).alias("gross_trade_dollar"), F.avg("adv_participation").alias("mean_adv_participation")
    )
    p95 = group_quantiles(penetration, ["date"], F.col("adv_participation"), (0.95,), ("p95_adv_participation",), max_group=max_group, split_rows=split_rows)
    turnover = F.col("gross_trade_dollar") / F.lit(float(portfolio_value))
    return attach(totals, p95, ["date"]).withColumn("turnover", turnover).withColumn(
        "turnover_x_liquidity", F.col("turnover") * F.col("mean_adv_participation")
    )


def concentration_liquidity_flags(penetration: DataFrame, *, concentration_weight_threshold: float, max_adv_participation: float) -> DataFrame:
    """Rows that are both concentrated and illiquid."""
    heavy = F.abs(clean("target_weight")) >= F.lit(float(concentration_weight_threshold)) if "target_weight" in penetration.columns else F.lit(False)
    thin = F.col("adv_participation") > F.lit(float(max_adv_participation))
    return penetration.where(heavy & thin).withColumn("concentration_liquidity_flag", F.lit(True))


def capacity_warning_summary(penetration: DataFrame, stress: DataFrame, flags: DataFrame) -> DataFrame:
    rows = penetration.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("adv_limit_flag").alias("n_adv_limit_flags"),
        ratio(F.count_if("adv_limit_flag"), F.count(F.lit(1))).alias("adv_limit_flag_ratio"),
    )
    return rows.withColumns(
        {
            "max_turnover_x_liquidity": stress.agg(F.max("turnover_x_liquidity")).scalar(),
            "n_concentration_liquidity_flags": flags.agg(F.count(F.lit(1))).scalar(),
        }
    )


def run_capacity_diagnostics(
    trades: DataFrame, *, portfolio_value: float, max_adv_participation: float = 0.05, concentration_weight_threshold: float = 0.05,
    max_group: int | None = None,
) -> dict[str, DataFrame]:
    if concentration_weight_threshold <= 0:
        raise ValueError("concentration_weight_threshold must be > 0")
    pen = adv_penetration_table(trades, max_adv_participation=max_adv_participation)
    stress = turnover_liquidity_stress(pen, portfolio_value=portfolio_value, max_group=max_group)
    flags = concentration_liquidity_flags(
        pen, concentration_weight_threshold=concentration_weight_threshold, max_adv_participation=max_adv_participation
    )
    return {
        "adv_penetration": pen,
        "turnover_liquidity": stress,
        "concentration_flags": flags,
        "warnings": capacity_warning_summary(pen, stress, flags),
    }


def industry_exposure(merged: DataFrame, *, weight_col: str = "weight", industry_col: str = "industry") -> DataFrame:
    return merged.where(F.col(industry_col).isNotNull()).groupBy("date", F.col(industry_col).alias("industry")).agg(
        F.coalesce(F.sum(clean(weight_col)), F.lit(0.0)).alias("net_weight")
    )


def style_exposure(merged: DataFrame, columns: Sequence[str], *, weight_col: str = "weight") -> DataFrame:
    """sum(weight x exposure) over complete pairs; NULL where a date has none."""
    items = [F.struct(F.lit(c).alias("exposure_name"), clean(c).alias("x")) for c in sorted(set(columns))]
    long = merged.select("date", clean(weight_col).alias("w"), F.inline(F.array(*items)))
    return long.groupBy("date", "exposure_name").agg(F.sum(F.col("w") * F.col("x")).alias("weighted_exposure"))


def run_exposure_audit(
    weights: DataFrame, exposures: DataFrame, *, weight_col: str = "weight", industry_col: str | None = "industry",
    size_col: str | None = "size_exposure", beta_col: str | None = "beta_exposure", style_cols: Sequence[str] = (),
) -> dict[str, DataFrame]:
    # Exposures without a weight aren't moved by the join.
    own = exposures.join(weights.select("date", "asset").distinct(), ["date", "asset"], "left_semi")
    merged = weights.select("date", "asset", weight_col).join(own, ["date", "asset"], "left")
    styles = [c for c in (size_col, beta_col, *style_cols) if c and c in merged.columns]
    out: dict[str, DataFrame] = {}
    if industry_col and industry_col in merged.columns:
        out["industry_exposure"] = industry_exposure(merged, weight_col=weight_col, industry_col=industry_col)
    if styles:
        out["style_exposure"] = style_exposure(merged, styles, weight_col=weight_col)
    out["summary"] = exposure_summary(out.get("industry_exposure"), out.get("style_exposure"))
    return out


def exposure_summary(industry: DataFrame | None, styles: DataFrame | None) -> DataFrame:
    if industry is None and styles is None:
        raise ValueError("at least one exposure table is required")
    none = F.lit(None).cast("double")
    top = {"i": (industry, "net_weight"), "s": (styles, "weighted_exposure")}
    parts = {k: (df.agg(F.struct(F.max(F.abs(c)).alias("m"), F.count(F.lit(1)).alias("n"))).scalar() if df is not None else None) for k, (df, c) in top.items()}
    base = (industry if industry is not None else styles).sparkSession.range(1)

    def pick(k: str, field: str, default: Column) -> Column:
        return parts[k][field] if parts[k] is not None else default

    return base.select(
        pick("i", "m", none).alias("max_abs_industry_exposure"), pick("i", "n", F.lit(0).cast("long")).alias("n_industry_cells"),
        pick("s", "n", F.lit(0).cast("long")).alias("n_style_cells"), pick("s", "m", none).alias("max_abs_style_exposure"),
    )
