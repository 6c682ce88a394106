"""Typed readers and sorted writers for panel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from panelyard.functions.columns import number
from panelyard.sources.contracts import require_columns

#: standard tables that a vendor may not offer
OPTIONAL_TABLES = ("financial_indicators",)
# Column lists of the canonical tables and sort keys of the raw tables.
TABLE_SCHEMAS: dict[str, str] = {
    "prices": "date DATE, asset STRING, close DOUBLE, open DOUBLE, high DOUBLE, low DOUBLE, pre_close DOUBLE, "
    "pct_chg DOUBLE, change DOUBLE, volume DOUBLE, dollar_volume DOUBLE, dollar_volume_yuan DOUBLE, pb DOUBLE, "
    "pe_ttm DOUBLE, total_mv_yuan DOUBLE, circ_mv_yuan DOUBLE, adj_factor DOUBLE",
    "asset_metadata": "asset STRING, listing_date DATE, delist_date DATE, is_st BOOLEAN, industry STRING, "
    "market STRING, exchange STRING, name STRING, list_status STRING, is_hs STRING",
    "trade_calendar": "date DATE, exchange STRING, is_open BOOLEAN, pretrade_date DATE",
    "market_state": "date DATE, asset STRING, is_halted BOOLEAN, is_limit_locked BOOLEAN, is_st BOOLEAN",
    "daily_fundamentals": "date DATE, asset STRING, turnover_rate DOUBLE, turnover_rate_f DOUBLE, volume_ratio DOUBLE, "
    "pe DOUBLE, pe_ttm DOUBLE, pb DOUBLE, ps DOUBLE, ps_ttm DOUBLE, dv_ratio DOUBLE, dv_ttm DOUBLE, total_share DOUBLE, "
    "float_share DOUBLE, free_share DOUBLE, total_mv DOUBLE, circ_mv DOUBLE, total_mv_yuan DOUBLE, circ_mv_yuan DOUBLE",
    "financial_indicators": "asset STRING, announce_date DATE, report_period DATE, roe DOUBLE, roe_dt DOUBLE, "
    "roa DOUBLE, grossprofit_margin DOUBLE, netprofit_margin DOUBLE",
}
RAW_SORT_KEYS: dict[str, tuple[str, ...]] = {
    "trade_cal": ("exchange", "cal_date"),
    "stock_basic": ("ts_code", "list_status"),
    "daily": ("trade_date", "ts_code"),
    "daily_basic": ("trade_date", "ts_code"),
    "adj_factor": ("trade_date", "ts_code"),
    "suspend_d": ("trade_date", "ts_code"),
    "stk_limit": ("trade_date", "ts_code"),
    "fina_indicator": ("ann_date", "end_date", "ts_code"),
    "fina_indicator_vip": ("ann_date", "end_date", "ts_code"),
}


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Price panel with at least (date, asset, close); other columns are kept.

    CSV columns arrive as text and are cast here, so nothing is inferred from the data and
    an unreadable date or number becomes NULL for the price contract to count.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    raw = reader.format(fmt).load(path)
    require_columns(raw, ("date", "asset", "close"), "prices")
    optional = [c for c in ("open", "high", "low", "volume", "dollar_volume") if c in raw.columns]
    casts = {"date": F.col("date").try_cast("date"), "asset": F.col("asset").cast("string"), "close": number("close")}
    casts.update({c: number(c) for c in optional})
    return raw.withColumns(casts)


def read_standard_table(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    schema = T.StructType.fromDDL(TABLE_SCHEMAS[name])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(f"{directory.rstrip('/')}/{name}")


def read_standard_tables(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """All standard tables; an optional one that was never written reads as an empty table."""
    out = {}
    for name, schema in TABLE_SCHEMAS.items():
        try:
            out[name] = read_standard_table(spark, directory, name, fmt)
        except AnalysisException as exc:
            if name not in OPTIONAL_TABLES or exc.getCondition() != "PATH_NOT_FOUND":
                raise
            out[name] = spark.createDataFrame([], T.StructType.fromDDL(schema))
    return out


def read_raw_table(
    spark: SparkSession, directory: str, name: str, schema: str, *, required: bool = True, fmt: str = "parquet"
) -> DataFrame:
    """Raw snapshot table; a missing optional table reads as an empty table of ``schema``."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    try:
        return reader.format(fmt).load(f"{directory.rstrip('/')}/{name}")
    except AnalysisException as exc:
        if required or exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType.fromDDL(schema))


def write_sorted(
    df: DataFrame,
    path: str,
    sort_keys: Sequence[str],
    *,
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
    fmt: str = "parquet",
) -> None:
    """Range-partitioned, locally sorted write: file footers get tight key ranges to prune by.

    All columns join the range key after the sort keys, so that one hot key is spread over
    several files.
    """
    require_columns(df, sort_keys, "table")
    spread = [*sort_keys, *[c for c in df.columns if c not in sort_keys]]
    writer = df.repartitionByRange(*spread).sortWithinPartitions(*sort_keys).write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def write_raw_table(df: DataFrame, directory: str, name: str, sort_keys: Sequence[str] | None = None, **options) -> None:
    keys = [c for c in (sort_keys or RAW_SORT_KEYS[name]) if c in df.columns]
    write_sorted(df, f"{directory.rstrip('/')}/{name}", keys, **options)
