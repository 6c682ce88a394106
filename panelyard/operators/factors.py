"""Time-series factors per asset.

Look-backs count rows of the asset's own history, never calendar days. Any function
``DataFrame -> DataFrame`` with the output columns (date, asset, factor, value) is a factor
and can be passed wherever a factor is expected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, gated, ieee_ratio, ratio
from panelyard.sources.contracts import require_columns

FactorFn = Callable[[DataFrame], DataFrame]


def positive_close() -> Column:
    close = clean("close")
    return F.when(close > 0, close)


def momentum(prices: DataFrame, *, window: int = 20, min_periods: int | None = None, positive: bool = True) -> DataFrame:
    """close[t] / close[t - window] - 1, given enough valid closes in the window + 1 rows.

    Closes of 0 or less are missing. With ``positive`` off they are valid, for levels that aren't prices: a change from 0
    is then infinite, or NaN from 0 to 0.
    """
    require_columns(prices, ("date", "asset", "close"), "prices")
    needed = window + 1 if min_periods is None else min_periods
    if window <= 0:
        raise ValueError("'window' must be a positive integer")
    if not 0 < needed <= window + 1:
        raise ValueError("'min_periods' must be between 1 and window + 1")
    own = W.partitionBy("asset").orderBy("date")
    close = F.col("__c")
    change = (ratio if positive else ieee_ratio)(close, F.lag(close, window).over(own)) - 1
    value = gated(change, F.count(close).over(own.rowsBetween(-window, 0)), needed)
    return prices.select("date", "asset", (positive_close() if positive else clean("close")).alias("__c")).select(
        "date", "asset", F.lit(f"momentum_{window}d").alias("factor"), value.alias("value")
    )


def reversal(prices: DataFrame, *, window: int = 5, min_periods: int | None = None) -> DataFrame:
    return momentum(prices, window=window, min_periods=min_periods).withColumns(
        {"factor": F.lit(f"reversal_{window}d"), "value": -F.col("value")}
    )


def low_volatility(prices: DataFrame, *, window: int = 20, min_periods: int | None = None) -> DataFrame:
    """Negative sample deviation of one-row returns over ``window`` rows."""
    require_columns(prices, ("date", "asset", "close"), "prices")
    needed = window if min_periods is None else min_periods
    if window <= 0:
        raise ValueError("'window' must be a positive integer")
    if not 0 < needed <= window:
        raise ValueError("'min_periods' must be between 1 and window")
    own = W.partitionBy("asset").orderBy("date")
    frame = own.rowsBetween(-(window - 1), 0)
    ret = ratio(F.col("__c"), F.lag("__c").over(own)) - 1
    return (
        prices.select("date", "asset", positive_close().alias("__c")).select("date", "asset", ret.alias("__r"))
        .select(
            "date", "asset", F.lit(f"low_volatility_{window}d").alias("factor"),
            (-gated(F.stddev_samp("__r").over(frame), F.count("__r").over(frame), needed)).alias("value"),
        )
    )
