"""Standardization of raw vendor tables into canonical panel tables.

Rows that a strict in-memory loader would reject are counted by the ``*_violations`` helpers
instead of failing inside an expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import as_col, flag, number
from panelyard.sources.contracts import coerce_bool, require_columns, rule_counts

# Fixed values of the vendor format.
FUNDAMENTAL_COLUMNS = (
    "turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm",
    "total_share", "float_share", "free_share", "total_mv", "circ_mv",
)
INDICATOR_COLUMNS = ("roe", "roe_dt", "roa", "grossprofit_margin", "netprofit_margin")
SHARES_PER_LOT = 100.0
MONEY_PER_UNIT = 1000.0
MARKET_VALUE_UNIT = 10000.0
NO_VOLUME = 1e-8
AT_LIMIT = 1e-6


def normalize_asset(c: Column | str) -> Column:
    """Trimmed upper-case identifier; blank becomes NULL and is counted by the contracts."""
    text = F.upper(F.trim(as_col(c).cast("string")))
    return F.when(text != "", text)


def normalize_date(c: Column | str) -> Column:
    """``yyyyMMdd`` or an ISO-like date (``-`` or ``/``, any time part dropped), NULL otherwise.

    Eight digits are rewritten to ISO and cast: a formatter would raise and catch an exception
    for every row in the other format.
    """
    text = F.translate(F.trim(as_col(c).cast("string")), "/", "-")
    compact = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    return F.when(text.rlike("^[0-9]{8}$"), compact).otherwise(text).try_cast("date")


def raw_violations(df: DataFrame, *, asset: str | None = None, dates: tuple[str, ...] = (), numbers: tuple[str, ...] = ()) -> DataFrame:
    """Counts of blank identifiers, unreadable dates and non-numeric required numbers."""
    rules: dict[str, Column] = {}
    if asset:
        rules[f"blank_{asset}"] = normalize_asset(asset).isNull()
    rules.update({f"invalid_{d}": normalize_date(d).isNull() for d in dates})
    rules.update({f"non_numeric_{n}": number(n).isNull() for n in numbers})
    return rule_counts(df, rules)


def _optional_number(df: DataFrame, name: str) -> Column:
    return number(name) if name in df.columns else F.lit(None).cast("double")


def _optional_text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def standardize_prices(daily: DataFrame, daily_basic: DataFrame | None = None, adj_factor: DataFrame | None = None) -> DataFrame:
    require_columns(daily, ("ts_code", "trade_date", "close"), "daily")
    kept = [c for c in ("open", "high", "low", "pre_close", "pct_chg", "change") if c in daily.columns]
    out = daily.select(
        normalize_date("trade_date").alias("date"),
        normalize_asset("ts_code").alias("asset"),
        number("close").alias("close"),
        *[number(c).alias(c) for c in kept],
        (_optional_number(daily, "vol") * F.lit(SHARES_PER_LOT)).alias("volume"),
        (_optional_number(daily, "amount") * F.lit(MONEY_PER_UNIT)).alias("dollar_volume"),
    ).withColumn("dollar_volume_yuan", F.col("dollar_volume"))
    extra = ("pb", "pe_ttm", "total_mv_yuan", "circ_mv_yuan")
    if daily_basic is not None:
        out = out.join(standardize_daily_basic(daily_basic).select("date", "asset", *extra), ["date", "asset"], "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in extra})
    if adj_factor is not None:
        factor = adj_factor.select(
            normalize_date("trade_date").alias("date"),
            normalize_asset("ts_code").alias("asset"),
            number("adj_factor").alias("adj_factor"),
        )
        return out.join(factor, ["date", "asset"], "left")
    return out.withColumn("adj_factor", F.lit(None).cast("double"))


def standardize_asset_metadata(stock_basic: DataFrame) -> DataFrame:
    """One row per asset: the latest listing (ties: last by listing status, then name)."""
    require_columns(stock_basic, ("ts_code", "list_date"), "stock_basic")
    texts = ("industry", "market", "exchange", "name", "list_status", "is_hs")
    rows = stock_basic.select(
        normalize_asset("ts_code").alias("asset"),
        normalize_date("list_date").alias("listing_date"),
        (normalize_date("delist_date") if "delist_date" in stock_basic.columns else F.lit(None).cast("date")).alias("delist_date"),
        *[_optional_text(stock_basic, c).alias(c) for c in texts],
    ).withColumn("is_st", F.coalesce(F.contains(F.upper("name"), F.lit("ST")), F.lit(False)))
    # max of a struct keeps one candidate per map task, where a row number would shuffle and sort every listing.
    order = F.struct(F.col("listing_date"), F.coalesce("list_status", F.lit("")), F.coalesce("name", F.lit("")))
    body = F.struct("listing_date", "delist_date", "is_st", *texts)
    return rows.groupBy("asset").agg(F.max_by(body, order).alias("b")).select("asset", "b.*")


def standardize_trade_calendar(trade_cal: DataFrame) -> DataFrame:
    require_columns(trade_cal, ("exchange", "cal_date", "is_open"), "trade_cal")
    previous = normalize_date("pretrade_date") if "pretrade_date" in trade_cal.columns else F.lit(None).cast("date")
    return trade_cal.select(
        normalize_date("cal_date").alias("date"), "exchange", coerce_bool("is_open").alias("is_open"), previous.alias("pretrade_date")
    )


def standardize_daily_basic(daily_basic: DataFrame) -> DataFrame:
    require_columns(daily_basic, ("ts_code", "trade_date"), "daily_basic")
    return daily_basic.select(
        normalize_date("trade_date").alias("date"),
        normalize_asset("ts_code").alias("asset"),
        *[_optional_number(daily_basic, c).alias(c) for c in FUNDAMENTAL_COLUMNS],
    ).withColumns(
        {
            "total_mv_yuan": F.col("total_mv") * F.lit(MARKET_VALUE_UNIT),
            "circ_mv_yuan": F.col("circ_mv") * F.lit(MARKET_VALUE_UNIT),
        }
    )


def standardize_indicators(indicators: DataFrame) -> DataFrame:
    require_columns(indicators, ("ts_code", "ann_date", "end_date"), "fina_indicator")
    return indicators.select(
        normalize_asset("ts_code").alias("asset"),
        normalize_date("ann_date").alias("announce_date"),
        normalize_date("end_date").alias("report_period"),
        *[_optional_number(indicators, c).alias(c) for c in INDICATOR_COLUMNS],
    )


def merge_indicator_sources(fallback: DataFrame | None, primary: DataFrame | None) -> DataFrame | None:
    """UNION DISTINCT of the two endpoints that may hold financial indicators."""
    present = [df for df in (fallback, primary) if df is not None]
    if len(present) < 2:
        return present[0] if present else None
    return present[0].unionByName(present[1], allowMissingColumns=True).distinct()


def standardize_market_state(
    prices: DataFrame, asset_metadata: DataFrame, suspend: DataFrame | None = None, stk_limit: DataFrame | None = None
) -> DataFrame:
    out = prices.select("date", "asset", "close", "high", "low", "volume").join(
        asset_metadata.select("asset", "is_st"), "asset", "left"
    )
    halted = F.abs(F.coalesce("volume", F.lit(0.0))) <= F.lit(NO_VOLUME)
    if suspend is not None:
        keys = suspend.select(
            normalize_date("trade_date").alias("date"), normalize_asset("ts_code").alias("asset")
        ).distinct().withColumn("__suspended", F.lit(True))
        out = out.join(keys, ["date", "asset"], "left")
        halted = halted | F.coalesce("__suspended", F.lit(False))
    locked = F.lit(False)
    if stk_limit is not None:
        limits = stk_limit.select(
            normalize_date("trade_date").alias("date"),
            normalize_asset("ts_code").alias("asset"),
            number("up_limit").alias("up_limit"),
            number("down_limit").alias("down_limit"),
        )
        out = out.join(limits, ["date", "asset"], "left")

        def at(price: str, bound: str) -> Column:
            return F.coalesce(F.abs(F.col(price) - F.col(bound)) <= F.lit(AT_LIMIT), F.lit(False))

        locked = (at("high", "up_limit") | at("low", "down_limit")) & (at("close", "up_limit") | at("close", "down_limit"))
    return out.select("date", "asset", halted.alias("is_halted"), locked.alias("is_limit_locked"), flag("is_st").alias("is_st"))


def open_dates(trade_cal: DataFrame, start: str, end: str) -> DataFrame:
    """Distinct open trading dates of a raw calendar inside [start, end]."""
    is_open = (number("is_open") == 1) | F.lower(F.trim(F.col("is_open").cast("string"))).isin("true", "t", "y", "yes")
    cal = trade_cal.select(normalize_date("cal_date").alias("date"), F.coalesce(is_open, F.lit(False)).alias("open"))
    return cal.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("open")).select("date").distinct()


def quarter_ends(bounds: DataFrame) -> DataFrame:
    """Last days of all quarters touched by any (start, end) row of ``bounds``."""
    firsts = F.sequence(F.trunc("start", "quarter"), F.col("end"), F.expr("interval 3 months"))
    return bounds.select(F.explode(firsts).alias("q")).select(F.last_day(F.add_months("q", 2)).alias("period")).distinct()
