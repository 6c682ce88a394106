"""Forward-looking labels per asset; horizons count rows of the asset's own history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, gated, ratio
from panelyard.functions.groups import with_ranks
from panelyard.operators.factors import positive_close
from panelyard.sources.contracts import require_columns

# Columns of the unified label table.
UNIFIED_LABEL_COLUMNS = (
    "date", "asset", "label_name", "label_type", "label_value", "event_start", "event_end", "trigger",
    "realized_horizon", "confidence",
)


def _own() -> W:
    return W.partitionBy("asset").orderBy("date")


def _unified(df: DataFrame, **columns: Column) -> DataFrame:
    defaults = {"date": F.col("date"), "asset": F.col("asset"), "event_start": F.col("date")}
    defaults.update(columns)
    defaults["realized_horizon"] = defaults["realized_horizon"].cast("double")
    return df.select(*[defaults[c].alias(c) for c in UNIFIED_LABEL_COLUMNS])


def forward_return(prices: DataFrame, *, horizon: int = 1) -> DataFrame:
    require_columns(prices, ("date", "asset", "close"), "prices")
    if horizon <= 0:
        raise ValueError("'horizon' must be a positive integer")
    value = ratio(F.lead("__c", horizon).over(_own()), F.col("__c")) - 1
    return prices.select("date", "asset", positive_close().alias("__c")).select(
        "date", "asset", F.lit(f"forward_return_{horizon}").alias("factor"), value.alias("value")
    )


def regression_forward_label(prices: DataFrame, *, horizon: int = 1, label_name: str | None = None) -> DataFrame:
    if horizon <= 0:
        raise ValueError("'horizon' must be a positive integer")
    value = ratio(F.lead("__c", horizon).over(_own()), F.col("__c")) - 1
    base = prices.select("date", "asset", positive_close().alias("__c"))
    base = base.withColumns({"__v": value, "__end": F.lead("date", horizon).over(_own())})
    return _unified(
        base,
        label_name=F.lit(label_name or f"forward_return_{horizon}"),
        label_type=F.lit("regression"),
        label_value=F.col("__v"),
        event_end=F.col("__end"),
        trigger=F.lit("horizon_end"),
        realized_horizon=F.lit(horizon),
        confidence=F.lit(None).cast("double"),
    )


def rankpct_label(
    prices: DataFrame, *, horizon: int = 1, label_name: str | None = None, max_group: int | None = None
) -> DataFrame:
    base = regression_forward_label(prices, horizon=horizon, label_name=label_name or f"rankpct_forward_return_{horizon}")
    ranked = with_ranks(base, ["date"], F.col("label_value"), average="__r", size="__n", max_group=max_group)
    pct = F.col("__r") / F.col("__n")
    return ranked.withColumns(
        {
            "label_type": F.lit("ranking"),
            "label_value": pct,
            "trigger": F.lit("cross_section_rank"),
            "confidence": F.abs(pct - 0.5),
        }
    ).select(*UNIFIED_LABEL_COLUMNS)


def triple_barrier_labels(
    prices: DataFrame,
    *,
    horizon: int,
    pt_mult: float = 1.0,
    sl_mult: float = 1.0,
    volatility_lookback: int = 20,
    label_name: str = "triple_barrier",
) -> DataFrame:
    """First barrier touched within ``horizon`` rows: +1 upper, -1 lower, 0 timeout.

    The forward path is a frame of at most ``horizon`` rows, so the collected array is
    bounded by the parameter, not by the data.
    """
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    if pt_mult <= 0 or sl_mult <= 0:
        raise ValueError("pt_mult and sl_mult must be > 0")
    if volatility_lookback <= 1:
        raise ValueError("volatility_lookback must be > 1")
    own = _own()
    close = F.col("__c")
    back = own.rowsBetween(-(volatility_lookback - 1), 0)
    rows = prices.select("date", "asset", clean("close").alias("__c")).withColumns(
        {
            "__r": ratio(close, F.lag(close).over(own)) - 1,
            "__path": F.collect_list(F.struct(F.col("date").alias("d"), close.alias("c"))).over(own.rowsBetween(1, horizon)),
        }
    )
    rows = rows.withColumn("__s", gated(F.stddev_pop("__r").over(back), F.count("__r").over(back), 2))
    usable = (F.size("__path") >= horizon) & (F.col("__s") > 0)
    upper = close * (F.lit(1.0) + F.lit(float(pt_mult)) * F.col("__s"))
    lower = close * (F.lit(1.0) - F.lit(float(sl_mult)) * F.col("__s"))
    rows = rows.withColumns({"__ok": F.coalesce(usable, F.lit(False)), "__up": upper, "__lo": lower})
    touched = F.transform("__path", lambda p: (p["c"] >= F.col("__up")) | (p["c"] <= F.col("__lo")))
    rows = rows.withColumn("__j", F.array_position(touched, True))
    end_at = F.when(F.col("__j") > 0, F.col("__j")).otherwise(F.lit(horizon)).cast("int")
    rows = rows.withColumn("__end", F.when(F.col("__ok"), F.get("__path", end_at - 1)))
    hit_up = (F.col("__j") > 0) & (F.col("__end.c") >= F.col("__up"))
    hit_low = (F.col("__j") > 0) & ~(F.col("__end.c") >= F.col("__up"))
    ok = F.col("__ok")
    return _unified(
        rows,
        label_name=F.lit(label_name),
        label_type=F.lit("event_classification"),
        label_value=F.when(ok, F.when(hit_up, 1.0).when(hit_low, -1.0).otherwise(0.0)),
        event_end=F.col("__end.d"),
        trigger=F.when(~ok, "insufficient_forward_window").when(hit_up, "upper_barrier").when(hit_low, "lower_barrier").otherwise("vertical_barrier"),
        realized_horizon=F.when(ok, end_at),
        confidence=F.when(ok, ratio(F.abs(ratio(F.col("__end.c"), close) - 1), F.greatest(F.col("__s"), F.lit(1e-12)))),
    )


def trend_scanning_labels(
    prices: DataFrame, *, min_horizon: int = 2, max_horizon: int = 20, label_name: str = "trend_scan"
) -> DataFrame:
    """Sign of the strongest linear trend of log price over horizons min..max.

    One fold over the forward array per row: the regression on 0..h is extended point by
    point, and the residual sum grows by the squared one-step prediction error over
    (1 + leverage), a sum of positive terms without cancellation. Nothing is exploded.
    A perfect fit has no t-statistic; when the first horizon has none, the label stays
    NULL, and a later horizon without one never wins.
    """
    if min_horizon < 2:
        raise ValueError("min_horizon must be >= 2")
    if max_horizon < min_horizon:
        raise ValueError("max_horizon must be >= min_horizon")
    own = _own()
    y = F.ln(positive_close())
    rows = prices.select("date", "asset", y.alias("__y")).withColumn(
        "__path", F.collect_list(F.struct(F.col("date").alias("d"), F.col("__y").alias("y"))).over(own.rowsBetween(0, max_horizon))
    )
    null, none = F.lit(None).cast("double"), F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("m"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("sxy"), F.lit(0.0).alias("ssr"), F.lit(0.0).alias("syy"),
        null.alias("t"), none.alias("h"),
    )

    def bind(value: Column, body: Callable[[Column], Column]) -> Column:
        """Evaluate ``value`` once and use it several times in ``body``."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def extend(acc: Column, p: Column) -> Column:
        m = acc["m"].cast("double")
        n = m + 1
        dx = n / F.lit(2.0)
        sxx, sxx_n = m * (m * m - 1) / F.lit(12.0), n * (n * n - 1) / F.lit(12.0)
        leverage = F.lit(1.0) / m + dx * dx / sxx

        def moments(dy: Column) -> Column:
            miss = dy - acc["sxy"] / sxx * dx
            ssr = F.when(m >= 2, acc["ssr"] + F.pow(miss, F.lit(2.0)) / (F.lit(1.0) + leverage)).otherwise(F.lit(0.0))
            gain = dy * m / n
            return F.struct((acc["mean"] + dy / n).alias("mean"), (acc["sxy"] + dx * gain).alias("sxy"), ssr.alias("ssr"), (acc["syy"] + dy * gain).alias("syy"))

        def tested(s: Column) -> Column:
            # A residual at rounding level counts as a perfect fit.
            t = F.when((m >= 2) & (s["ssr"] > s["syy"] * F.lit(1e-28)), (s["sxy"] / sxx_n) / F.sqrt(s["ssr"] / (n - 2) / sxx_n))
            return F.struct(s.alias("s"), t.alias("t"))

        def kept(r: Column) -> Column:
            better = (acc["m"] >= min_horizon) & (acc["h"].isNull() | F.coalesce(F.abs(r["t"]) > F.abs(acc["t"]), F.lit(False)))
            s = r["s"]
            return F.struct(
                (acc["m"] + 1).alias("m"), s["mean"].alias("mean"), s["sxy"].alias("sxy"), s["ssr"].alias("ssr"), s["syy"].alias("syy"),
                F.when(better, r["t"]).otherwise(acc["t"]).alias("t"), F.when(better, acc["m"]).otherwise(acc["h"]).alias("h"),
            )

        first = F.struct(F.lit(1).alias("m"), p["y"].alias("mean"), *[F.lit(0.0).alias(c) for c in ("sxy", "ssr", "syy")], null.alias("t"), none.alias("h"))
        return F.when(acc["m"] == 0, first).otherwise(bind(bind(bind(p["y"] - acc["mean"], moments), tested), kept))

    rows = rows.withColumn("__b", F.aggregate("__path", start, extend))
    found = F.col("__b.h").isNotNull()
    return _unified(
        rows,
        label_name=F.lit(label_name),
        label_type=F.lit("event_classification"),
        label_value=F.signum("__b.t"),
        event_end=F.when(found, F.get("__path", F.col("__b.h"))["d"]),
        trigger=F.when(found, "trend_scan").otherwise("insufficient_forward_window"),
        realized_horizon=F.col("__b.h"),
        confidence=F.abs("__b.t"),
    )


def labels_to_canonical(labels: DataFrame) -> DataFrame:
    return labels.select("date", "asset", F.col("label_name").alias("factor"), F.col("label_value").alias("value"))


def interval_samples(labels: DataFrame, *, fallback_horizon: int) -> DataFrame:
    """Event interval per label row; a missing end is ``realized_horizon`` calendar days ahead."""
    start = F.coalesce("event_start", "date")
    days = F.greatest(F.coalesce(F.col("realized_horizon"), F.lit(float(fallback_horizon))), F.lit(0.0)).cast("int")
    end = F.coalesce(F.col("event_end"), F.date_add("date", days))
    return labels.select("date", "asset", start.alias("event_start"), F.greatest(end, start).alias("event_end"))


def build_labels(
    prices: DataFrame, method: str, *, horizon: int, label_kwargs: dict | None = None, max_group: int | None = None
) -> DataFrame:
    """Unified labels by method name: forward_return, rankpct, triple_barrier or trend_scanning."""
    kwargs = dict(label_kwargs or {})
    if method == "forward_return":
        return regression_forward_label(prices, horizon=kwargs.pop("horizon", horizon), label_name=kwargs.pop("label_name", None))
    if method == "rankpct":
        return rankpct_label(prices, horizon=kwargs.pop("horizon", horizon), label_name=kwargs.pop("label_name", None), max_group=max_group)
    if method == "triple_barrier":
        return triple_barrier_labels(prices, **{"horizon": horizon, **kwargs})
    if method == "trend_scanning":
        low = kwargs.pop("min_horizon", 2)
        return trend_scanning_labels(
            prices, min_horizon=low, max_horizon=kwargs.pop("max_horizon", max(horizon, low)), label_name=kwargs.pop("label_name", "trend_scan")
        )
    raise ValueError(f"unsupported label method {method!r}")
