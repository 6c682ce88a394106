"""Research inputs built from standardized tables: exposures and candidate signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, gated, ratio
from panelyard.functions.groups import with_group_stats
from panelyard.operators.factors import momentum


def size_exposure(fundamentals: DataFrame, column: str = "total_mv_yuan") -> DataFrame:
    """Log market value, NULL where it is not positive."""
    mv = clean(column)
    return fundamentals.select("date", "asset", F.when(mv > 0, F.ln(mv)).alias("size_exposure"))


def rolling_market_beta(
    prices: DataFrame, *, window: int = 60, min_periods: int = 20, max_group: int | None = None
) -> DataFrame:
    """Rolling covariance with the equal-weight market return over its rolling variance.

    Rows are aligned by key: each asset's own price rows count towards the window. An in-memory
    date x asset grid would also count the dates on which the asset has no row.
    """
    own = W.partitionBy("asset").orderBy("date")
    close = clean("close")
    ret = prices.select("date", "asset", (ratio(close, F.lag(close).over(own)) - 1).alias("r"))
    # A mean a date, broadcast: the panel isn't moved by date and back by asset.
    ret = with_group_stats(ret, ["date"], {"m": F.avg("r")})
    frame = own.rowsBetween(-(window - 1), 0)
    both = F.col("r").isNotNull() & F.col("m").isNotNull()
    cov = gated(F.covar_samp(F.when(both, F.col("r")), F.when(both, F.col("m"))).over(frame), F.count(F.when(both, 1)).over(frame), min_periods)
    var = gated(F.var_samp("m").over(frame), F.count("m").over(frame), min_periods)
    return ret.select("date", "asset", ratio(cov, var).alias("beta_exposure"))


def neutralization_exposures(
    prices: DataFrame, fundamentals: DataFrame, asset_metadata: DataFrame, *, window: int = 60, min_periods: int = 20, max_group: int | None = None
) -> DataFrame:
    beta = rolling_market_beta(prices, window=window, min_periods=min_periods, max_group=max_group)
    return (
        beta.join(size_exposure(fundamentals), ["date", "asset"], "left")
        .join(asset_metadata.select("asset", "industry"), "asset", "left")
        .select("date", "asset", "size_exposure", "beta_exposure", "industry")
    )


def book_to_price(fundamentals: DataFrame, name: str = "value_book_to_price_proxy") -> DataFrame:
    pb = clean("pb")
    return fundamentals.select("date", "asset", F.lit(name).alias("factor"), F.when(pb > 0, ratio(F.lit(1.0), pb)).alias("value"))


def point_in_time_quality(prices: DataFrame, indicators: DataFrame, name: str = "quality_profitability_proxy") -> DataFrame:
    """Backward as-of join: on each price row the last quality value announced by then.

    Both sides are stacked and the last announced value is carried forward inside the asset,
    one shuffle and one sort instead of a range join. Several announcements of one day
    resolve to the latest report period.
    """
    quality = F.coalesce(clean("roe_dt"), clean("roe"), clean("roa"))
    announced = (
        indicators.select(
            "asset", F.col("announce_date").alias("date"), "report_period", quality.alias("q"), F.lit(0).alias("side")
        )
        .where(F.col("q").isNotNull() & F.col("date").isNotNull())
    )
    asked = prices.select("asset", "date").distinct().select(
        "asset", "date", F.lit(None).cast("date").alias("report_period"), F.lit(None).cast("double").alias("q"), F.lit(1).alias("side")
    )
    seen = W.partitionBy("asset").orderBy("date", "side", "report_period").rowsBetween(W.unboundedPreceding, 0)
    return (
        announced.unionByName(asked).withColumn("value", F.last("q", ignorenulls=True).over(seen))
        .where("side = 1").select("date", "asset", F.lit(name).alias("factor"), "value")
    )


def candidate_signals(prices: DataFrame, fundamentals: DataFrame, indicators: DataFrame, *, window: int = 63) -> DataFrame:
    return (
        momentum(prices, window=window)
        .unionByName(book_to_price(fundamentals))
        .unionByName(point_in_time_quality(prices, indicators))
    )
