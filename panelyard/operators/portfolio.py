"""Portfolio weights, overlapping-holdings returns, turnover, costs and the trade plan.

``keys`` prefixes every group (for example ("fold_id",)), so many portfolios run in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, gated, ratio
from panelyard.functions.groups import attach_small, with_group_stats, with_ranks
from panelyard.sources.contracts import require_columns

WEIGHT_METHODS = ("equal", "rank", "score")


@dataclass(frozen=True)
class Strategy:
    long_top_k: int | None = None
    short_bottom_k: int | None = None
    weighting_method: str = "equal"
    holding_period: int = 1
    rebalance_frequency: int = 1

    def __post_init__(self) -> None:
        for name in ("long_top_k", "short_bottom_k"):
            value = getattr(self, name)
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be a positive integer")
        if self.weighting_method not in WEIGHT_METHODS:
            raise ValueError(f"weighting_method must be one of {WEIGHT_METHODS}")
        if self.holding_period < 1 or self.rebalance_frequency < 1:
            raise ValueError("holding_period and rebalance_frequency must be >= 1")


def _leg_weights(legs: DataFrame, method: str, keys: Sequence[str], max_group: int | None) -> DataFrame:
    """Weight of every selected row inside its leg; ``__v`` is the value seen from the leg's side."""
    group = [*keys, "__leg"]
    if method == "rank":
        ranked = with_ranks(legs, group, F.col("__v"), average="__r", size="__n", max_group=max_group)
        # Average ranks of n rows always add up to n (n + 1) / 2.
        return ranked.withColumn("__w", F.col("__r") / (F.col("__n") * (F.col("__n") + 1) / F.lit(2.0)))
    stats = {"__n": F.count(F.lit(1)), "__lo": F.min("__v")}
    out = with_group_stats(legs, group, stats, max_group=max_group)
    even = F.lit(1.0) / F.col("__n")
    if method == "equal":
        return out.withColumn("__w", even)
    out = with_group_stats(out.withColumn("__x", F.col("__v") - F.col("__lo")), group, {"__total": F.sum("__x")}, max_group=max_group)
    return out.withColumn("__w", F.when(F.col("__total") > 0, F.try_divide(F.col("__x"), F.col("__total"))).otherwise(even))


def portfolio_weights(
    factors: DataFrame, method: str = "equal", *, top_k: int | None = None, bottom_k: int | None = None,
    keys: Sequence[str] = ("date",), max_group: int | None = None,
) -> DataFrame:
    """Signed weights: the top k long (+1 in total), the bottom k short (-1), never overlapping.

    Ties go by asset. With ``top_k`` the selection is a per-group limit that Spark applies
    before the shuffle too, so only k rows per group and task move.
    """
    if method not in WEIGHT_METHODS:
        raise ValueError(f"method must be one of {WEIGHT_METHODS}, got {method!r}")
    require_columns(factors, (*keys, "asset", "value"), "factors")
    if (top_k is not None and top_k <= 0) or (bottom_k is not None and bottom_k <= 0):
        raise ValueError("top_k and bottom_k must be positive integers")
    valid = factors.select(*keys, "asset", clean("value").alias("value")).where("value is not null")
    if top_k is None:
        legs = with_group_stats(valid, keys, {"__size": F.count(F.lit(1))}, max_group=max_group).where("__size >= 2")
        legs = legs.withColumns({"__leg": F.lit(1), "__v": F.col("value")})
        bound = max_group
    else:
        sizes = valid.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
        first = W.partitionBy(*keys).orderBy(F.col("value").desc(), F.col("asset").asc())
        longs = valid.withColumn("__k", F.row_number().over(first)).where(F.col("__k") <= top_k)
        longs = longs.withColumns({"__leg": F.lit(1), "__v": F.col("value")})
        legs = longs.join(sizes, list(keys)).where("__size >= 2")
        if bottom_k is not None:
            last = W.partitionBy(*keys).orderBy(F.col("value").asc(), F.col("asset").desc())
            shorts = valid.withColumn("__k", F.row_number().over(last)).where(F.col("__k") <= bottom_k)
            shorts = shorts.withColumns({"__leg": F.lit(-1), "__v": -F.col("value")})
            shorts = shorts.join(sizes, list(keys)).where(F.col("__size") >= 2).where(F.col("__k") <= F.col("__size") - top_k)
            legs = legs.unionByName(shorts)
        bound = max(top_k, bottom_k or 0)
    out = _leg_weights(legs, method, keys, bound)
    return out.select(*keys, "asset", (F.col("__w") * F.col("__leg")).alias("weight"))


def portfolio_weights_from_strategy(factors: DataFrame, spec: Strategy, **options) -> DataFrame:
    return portfolio_weights(factors, spec.weighting_method, top_k=spec.long_top_k, bottom_k=spec.short_bottom_k, **options)


def rebalance_dates(weights: DataFrame, rebalance_frequency: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Every n-th weight date, numbered from 0: columns keys, date, __i (at most one row per calendar day)."""
    every = weights.select(*keys, "date").distinct().withColumn(
        "__k", F.row_number().over(W.partitionBy(*keys).orderBy("date")) - 1
    )
    return every.where(F.col("__k") % rebalance_frequency == 0).select(
        *keys, "date", (F.col("__k") / rebalance_frequency).cast("int").alias("__i")
    )


def simulate_portfolio_returns(
    weights: DataFrame, returns: DataFrame, *, holding_period: int = 1, rebalance_frequency: int = 1, keys: Sequence[str] = ()
) -> DataFrame:
    """Mean over the active positions of sum(weight x return).

    On any date exactly the last ``holding_period`` rebalances are active, so the range
    condition becomes a small date -> rebalance date table and the panel joins are on equality.
    """
    if holding_period < 1 or rebalance_frequency < 1:
        raise ValueError("holding_period and rebalance_frequency must be >= 1")
    active = rebalance_dates(weights, rebalance_frequency, keys)
    asked = returns.select(*keys, "date").distinct().withColumn("__ask", F.lit(True))
    axis = asked.join(active.withColumn("__on", F.lit(1)), [*keys, "date"], "full_outer")
    latest = F.sum(F.coalesce("__on", F.lit(0))).over(W.partitionBy(*keys).orderBy("date")) - 1
    held = axis.withColumn("__last", latest.cast("int")).where("__ask and __last >= 0").select(
        *keys, "date", F.explode(F.sequence(F.greatest(F.lit(0), F.col("__last") - (holding_period - 1)), F.col("__last"))).alias("__i")
    )
    held = held.join(active.select(*keys, "__i", F.col("date").alias("__start")), [*keys, "__i"])
    # Positions are repeated for the dates they are held, never the returns, which are the larger table.
    positions = weights.select(*keys, F.col("date").alias("__start"), "asset", "weight")
    positions = attach_small(positions, held.select(*keys, "date", "__start"), [*keys, "__start"], "inner")
    rows = returns.select(*keys, "date", "asset", clean("value").alias("__r"))
    per_position = rows.join(positions, [*keys, "date", "asset"]).groupBy(*keys, "date", "__start").agg(
        F.coalesce(F.sum(F.col("weight") * F.col("__r")), F.lit(0.0)).alias("__p")
    )
    return per_position.groupBy(*keys, "date").agg(F.avg("__p").alias("portfolio_return"))


def weight_changes(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """|change| of every asset between consecutive panel dates; columns keys, date, change, is_first.

    A row compares with the asset's previous row when that lies on the previous panel date; an
    asset that is gone on the next panel date adds its full weight there.
    """
    w = W.partitionBy(*keys).orderBy("date")
    panel = weights.select(*keys, "date").distinct().withColumns({"__prev": F.lag("date").over(w), "__next": F.lead("date").over(w)})
    own = W.partitionBy(*keys, "asset").orderBy("date")
    rows = weights.select(*keys, "date", "asset", clean("weight").alias("__w")).withColumns(
        {"__ld": F.lag("date").over(own), "__lw": F.lag("__w").over(own), "__nd": F.lead("date").over(own)}
    )
    rows = attach_small(rows, panel, [*keys, "date"], "inner")
    stays = F.coalesce(F.col("__ld") == F.col("__prev"), F.lit(False))
    change = F.abs(F.col("__w") - F.when(stays, F.col("__lw")).otherwise(F.lit(0.0)))
    leaves = F.col("__next").isNotNull() & F.coalesce(F.col("__nd") != F.col("__next"), F.lit(True))
    both = F.array(
        F.struct(F.col("date").alias("date"), change.alias("change"), F.col("__prev").isNull().alias("is_first")),
        F.when(leaves, F.struct(F.col("__next").alias("date"), F.abs("__w").alias("change"), F.lit(False).alias("is_first"))),
    )
    return rows.select(*keys, F.inline(F.array_compact(both)))


def portfolio_turnover(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Half the sum of absolute weight changes; NULL on the first date."""
    return weight_changes(weights, keys).groupBy(*keys, "date").agg(
        F.when(~F.bool_or("is_first"), F.sum("change") / F.lit(2.0)).alias("portfolio_turnover")
    )


def portfolio_cost_adjusted_returns(returns: DataFrame, turnover: DataFrame, *, cost_rate: float, keys: Sequence[str] = ()) -> DataFrame:
    """Return minus cost; dates without a rebalance cost nothing, the first rebalance is NULL."""
    if cost_rate < 0:
        raise ValueError(f"cost_rate must be >= 0, got {cost_rate}")
    known = turnover.select(*keys, "date", "portfolio_turnover", F.lit(True).alias("__rebal"))
    paid = F.when(F.col("__rebal"), F.col("portfolio_turnover")).otherwise(F.lit(0.0))
    return returns.join(known, [*keys, "date"], "left").select(
        *keys, "date", "portfolio_return", (F.col("portfolio_return") - F.lit(float(cost_rate)) * paid).alias("adjusted_return")
    )


def portfolio_block(
    factors: DataFrame, returns: DataFrame, spec: Strategy, *, cost_rate: float | None = None, keys: Sequence[str] = (), max_group: int | None = None
) -> dict[str, DataFrame]:
    """Weights, one-period returns, turnover on rebalance dates and cost-adjusted returns."""
    weights = portfolio_weights_from_strategy(factors, spec, keys=(*keys, "date"), max_group=max_group)
    ret = simulate_portfolio_returns(
        weights, returns, holding_period=spec.holding_period, rebalance_frequency=spec.rebalance_frequency, keys=keys
    )
    active = weights.join(rebalance_dates(weights, spec.rebalance_frequency, keys).drop("__i"), [*keys, "date"], "left_semi")
    out = {"weights": weights, "returns": ret, "turnover": portfolio_turnover(active, keys)}
    if cost_rate is not None:
        out["cost_adjusted"] = portfolio_cost_adjusted_returns(ret, out["turnover"], cost_rate=cost_rate, keys=keys)
    return out


def summarise_portfolio(block: dict[str, DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    dated = [*keys, "date"]
    daily = block["returns"].join(block["turnover"], dated, "full_outer")
    if "cost_adjusted" in block:
        daily = daily.join(block["cost_adjusted"].select(*dated, "adjusted_return"), dated, "full_outer")
    else:
        daily = daily.withColumn("adjusted_return", F.lit(None).cast("double"))
    r = F.col("portfolio_return")
    return daily.groupBy(*keys).agg(
        F.avg(r).alias("mean_portfolio_return"),
        F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("portfolio_hit_rate"),
        F.avg("portfolio_turnover").alias("mean_portfolio_turnover"),
        F.avg("adjusted_return").alias("mean_cost_adjusted_return"),
        F.count(r).alias("n_portfolio_dates"),
    )


def dense_grid(df: DataFrame) -> DataFrame:
    """Every asset of the table on every date of the table.

    The calendar travels as one array (at most one entry per day) and each asset explodes it.
    """
    calendar = df.select("date").distinct().agg(F.array_sort(F.collect_list("date"))).scalar()
    return df.select("asset").distinct().withColumn("__d", calendar).select("asset", F.explode("__d").alias("date"))


def trade_plan(weights: DataFrame, prices: DataFrame, *, portfolio_value: float, adv_window: int) -> DataFrame:
    """Weight deltas, trade dollars, volatility and ADV over the dense date x asset grid.

    With a ``dollar_volume`` column ADV is the value of the day itself; only the close x volume
    fallback is a rolling mean. Windows run along an asset, so prices of assets without a weight aren't moved.
    """
    own = W.partitionBy("asset").orderBy("date")
    frame = own.rowsBetween(-(adv_window - 1), 0)
    target = dense_grid(weights).join(weights.select("date", "asset", "weight"), ["date", "asset"], "left").select(
        "date", "asset", F.coalesce("weight", F.lit(0.0)).alias("target_weight")
    )
    plan = target.withColumn("trade_weight", F.col("target_weight") - F.coalesce(F.lag("target_weight").over(own), F.lit(0.0)))
    plan = plan.withColumn("trade_dollar", F.col("trade_weight") * F.lit(float(portfolio_value)))
    close = clean("close")
    px = prices.join(weights.select("asset").distinct(), "asset", "left_semi").withColumn("__r", ratio(close, F.lag(close).over(own)) - 1)
    if "dollar_volume" in prices.columns:
        adv = clean("dollar_volume")
    elif "volume" in prices.columns:
        adv = F.avg(close * clean("volume")).over(frame)
    else:
        adv = F.lit(None).cast("double")
    px = px.select(
        "date", "asset", adv.alias("adv_dollar"), gated(F.stddev_pop("__r").over(frame), F.count("__r").over(frame), 2).alias("daily_volatility")
    )
    return plan.join(px, ["date", "asset"], "left").select(
        "date", "asset", "trade_weight", "trade_dollar", "target_weight", "adv_dollar", "daily_volatility"
    )
