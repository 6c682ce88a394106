"""Raw snapshots to standardized tables to research inputs, with Parquet between the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelyard.sources import vendor
from panelyard.sources.contracts import raise_on
from panelyard.sources.research_inputs import candidate_signals, neutralization_exposures
from panelyard.sources.tables import read_standard_tables, write_sorted


def validate_raw_tables(raw: dict[str, DataFrame | None]) -> None:
    """Raise on blank assets, unreadable dates or closes that aren't numbers, with the counts of each table."""
    checks = {
        "daily": dict(asset="ts_code", dates=("trade_date",), numbers=("close",)),
        "daily_basic": dict(asset="ts_code", dates=("trade_date",)),
        "stock_basic": dict(asset="ts_code"),
    }
    for name, rules in checks.items():
        raise_on(vendor.raw_violations(raw[name], **rules).where("rule <> 'empty_table'"), name)


def standardize_raw_tables(raw: dict[str, DataFrame | None], *, validate: bool = True) -> dict[str, DataFrame]:
    """Canonical tables from raw ones; adj_factor, suspend_d, stk_limit and the indicators may be absent.

    Raw tables that break their contract raise, unless ``validate`` is off.
    """
    if validate:
        validate_raw_tables(raw)
    prices = vendor.standardize_prices(raw["daily"], raw["daily_basic"], raw.get("adj_factor"))
    meta = vendor.standardize_asset_metadata(raw["stock_basic"])
    out = {
        "prices": prices,
        "asset_metadata": meta,
        "trade_calendar": vendor.standardize_trade_calendar(raw["trade_cal"]),
        "market_state": vendor.standardize_market_state(prices, meta, raw.get("suspend_d"), raw.get("stk_limit")),
        "daily_fundamentals": vendor.standardize_daily_basic(raw["daily_basic"]),
    }
    indicators = vendor.merge_indicator_sources(raw.get("fina_indicator"), raw.get("fina_indicator_vip"))
    if indicators is not None:
        out["financial_indicators"] = vendor.standardize_indicators(indicators)
    return out


def write_standard_tables(tables: dict[str, DataFrame], directory: str) -> None:
    keys = {"asset_metadata": ["asset"], "trade_calendar": ["exchange", "date"], "financial_indicators": ["asset", "announce_date"]}
    for name, df in tables.items():
        write_sorted(df, f"{directory.rstrip('/')}/{name}", keys.get(name, ["date", "asset"]))


def build_research_inputs(spark: SparkSession, directory: str, *, max_group: int | None = None) -> dict[str, DataFrame]:
    """Prices, metadata, market state, exposures and candidate signals from the standardized tables."""
    t = read_standard_tables(spark, directory)
    return {
        "prices": t["prices"].select("date", "asset", "close", "volume", "dollar_volume"),
        "asset_metadata": t["asset_metadata"].select("asset", "listing_date", "is_st", "industry"),
        "market_state": t["market_state"],
        "neutralization_exposures": neutralization_exposures(t["prices"], t["daily_fundamentals"], t["asset_metadata"], max_group=max_group),
        "candidate_signals": candidate_signals(t["prices"], t["daily_fundamentals"], t["financial_indicators"]),
    }
