"""Readers, writers, contracts and standardization on tables shaped like raw vendor files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelyard.catalog.panels import (
    MONTH_SQL, asset_meta, cte, exact_sum, fin_ann, fundamentals, mkt_state, mom3, month, px, sql_with, table,
)
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.functions.storage import scratch_dir
from panelyard.operators.evaluation import quantile_assignments
from panelyard.operators.labels import regression_forward_label
from panelyard.sources import contracts as ct
from panelyard.sources import vendor
from panelyard.sources.tables import read_prices, read_raw_table, read_standard_table, write_raw_table, write_sorted


def _scratch(spark):
    return f"{scratch_dir(spark)}/files/{uuid.uuid4().hex}"


# Raw vendor tables derived from the driver tables: padded lower-case codes, mixed date
# formats, text numbers, duplicates.
_CODE_SQL = "'  s' || asset || '.x '"
_DATE_SQL = "CASE WHEN cast(asset as integer) % 2 = 0 THEN strftime({d}, '%Y%m%d') ELSE strftime({d}, '%Y-%m-%d') END"


def _code():
    return F.concat(F.lit("  s"), F.col("asset"), F.lit(".x "))


def _date(c):
    even = F.col("asset").cast("int") % 2 == 0
    return F.when(even, F.date_format(c, "yyyyMMdd")).otherwise(F.date_format(c, "yyyy-MM-dd"))


cte(
    "raw_daily", "",
    f"""SELECT {_CODE_SQL} AS ts_code, {_DATE_SQL.format(d='date')} AS trade_date, CASE WHEN cast(asset as integer) % 4 = 0 THEN high ELSE low END AS close, high, low,
    CASE WHEN cast(asset as integer) % 7 = 0 THEN 'n/a' ELSE cast(qty as varchar) END AS vol, amount FROM (
    SELECT {MONTH_SQL} AS date, cast(l_suppkey as varchar) AS asset, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) AS qty, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) AS amount FROM lineitem GROUP BY 1, 2)""",
)


def raw_daily(spark, d):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    base = table(spark, d, "lineitem").groupBy(month("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("asset")).agg(
        F.max(unit).alias("high"), F.min(unit).alias("low"), exact_sum("l_quantity").alias("qty"), exact_sum("l_extendedprice").alias("amount")
    )
    n = F.col("asset").cast("int")
    return base.select(
        _code().alias("ts_code"), _date("date").alias("trade_date"), F.when(n % 4 == 0, F.col("high")).otherwise(F.col("low")).alias("close"), "high", "low",
        F.when(n % 7 == 0, F.lit("n/a")).otherwise(F.col("qty").cast("string")).alias("vol"), "amount",
    )


cte("raw_basic", "fundamentals", f"SELECT {_CODE_SQL} AS ts_code, {_DATE_SQL.format(d='date')} AS trade_date, pb, total_mv_yuan / 10000 AS total_mv FROM fundamentals")


def raw_basic(spark, d):
    return fundamentals(spark, d).select(
        _code().alias("ts_code"), _date("date").alias("trade_date"), "pb", (F.col("total_mv_yuan") / F.lit(10000.0)).alias("total_mv")
    )


cte("raw_adj", "px", f"SELECT {_CODE_SQL} AS ts_code, {_DATE_SQL.format(d='date')} AS trade_date, 1 + month(date) / 100.0::double AS adj_factor FROM px WHERE cast(asset as integer) % 3 = 0")


def raw_adj(spark, d):
    return px(spark, d).where(F.col("asset").cast("int") % 3 == 0).select(
        _code().alias("ts_code"), _date("date").alias("trade_date"), (F.lit(1.0) + F.month("date") / F.lit(100.0)).alias("adj_factor")
    )


cte(
    "raw_basic_info", "asset_meta",
    f"""SELECT {_CODE_SQL} AS ts_code, strftime(listing_date, '%Y%m%d') AS list_date, CASE WHEN is_st THEN '*st ' || asset ELSE 'corp ' || asset END AS name, industry, 'L' AS list_status FROM asset_meta
    UNION ALL SELECT {_CODE_SQL}, strftime(listing_date - 100, '%Y%m%d'), 'old ' || asset, industry, 'D' FROM asset_meta WHERE cast(asset as integer) % 5 = 0""",
)


def raw_basic_info(spark, d):
    meta = asset_meta(spark, d)
    now = meta.select(
        _code().alias("ts_code"), F.date_format("listing_date", "yyyyMMdd").alias("list_date"),
        F.when(F.col("is_st"), F.concat(F.lit("*st "), "asset")).otherwise(F.concat(F.lit("corp "), "asset")).alias("name"), "industry", F.lit("L").alias("list_status"),
    )
    old = meta.where(F.col("asset").cast("int") % 5 == 0).select(
        _code().alias("ts_code"), F.date_format(F.date_sub("listing_date", 100), "yyyyMMdd").alias("list_date"), F.concat(F.lit("old "), "asset").alias("name"),
        "industry", F.lit("D").alias("list_status"),
    )
    return now.unionByName(old)


_OPEN_SQL = "CASE extract(day FROM d) % 4 WHEN 0 THEN '1' WHEN 1 THEN ' TRUE ' WHEN 2 THEN '0' ELSE 'false' END"
cte("raw_cal", "", f"SELECT 'SSE' AS exchange, strftime(d, '%Y%m%d') AS cal_date, {_OPEN_SQL} AS is_open, strftime(d - 1, '%Y%m%d') AS pretrade_date FROM (SELECT DISTINCT cast(l_shipdate as date) AS d FROM lineitem)")


def raw_cal(spark, d):
    days = table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    k = F.dayofmonth("d") % 4
    return days.select(
        F.lit("SSE").alias("exchange"), F.date_format("d", "yyyyMMdd").alias("cal_date"),
        F.when(k == 0, "1").when(k == 1, " TRUE ").when(k == 2, "0").otherwise("false").alias("is_open"),
        F.date_format(F.date_sub("d", 1), "yyyyMMdd").alias("pretrade_date"),
    )


cte("raw_suspend", "", f"SELECT '  s' || cast(l_suppkey as varchar) || '.x ' AS ts_code, strftime({MONTH_SQL}, '%Y%m%d') AS trade_date FROM lineitem WHERE l_quantity >= 49")


def raw_suspend(spark, d):
    rows = table(spark, d, "lineitem").where("l_quantity >= 49")
    return rows.select(
        F.concat(F.lit("  s"), F.col("l_suppkey").cast("string"), F.lit(".x ")).alias("ts_code"), F.date_format(month("l_shipdate"), "yyyyMMdd").alias("trade_date")
    )


cte("raw_limit", "raw_daily", "SELECT ts_code, trade_date, CASE WHEN length(ts_code) % 2 = 0 THEN high ELSE high + 1 END AS up_limit, low AS down_limit FROM raw_daily WHERE substr(trade_date, 1, 4) <> '1999'")


def raw_limit(spark, d):
    even = F.length("ts_code") % 2 == 0
    return raw_daily(spark, d).where(F.substring("trade_date", 1, 4) != "1999").select(
        "ts_code", "trade_date", F.when(even, F.col("high")).otherwise(F.col("high") + 1).alias("up_limit"), F.col("low").alias("down_limit")
    )


cte("raw_fina", "fin_ann", f"SELECT {_CODE_SQL} AS ts_code, strftime(announce_date, '%Y%m%d') AS ann_date, strftime(report_period, '%Y%m%d') AS end_date, roe, roe_dt FROM fin_ann")


def raw_fina(spark, d):
    return fin_ann(spark, d).select(
        _code().alias("ts_code"), F.date_format("announce_date", "yyyyMMdd").alias("ann_date"), F.date_format("report_period", "yyyyMMdd").alias("end_date"), "roe", "roe_dt"
    )


# Scans and sinks.
@query("price_scan_csv", sql_with("px", "SELECT date, asset, close, volume, dollar_volume FROM px"))
def _(spark, d):
    path = _scratch(spark)
    write_sorted(px(spark, d), path, ["date", "asset"], fmt="csv")
    return read_prices(spark, path, "csv").select("date", "asset", "close", "volume", "dollar_volume")


@query("standard_table_scan", sql_with("mkt_state", "SELECT date, asset, is_halted, is_limit_locked, cast(null as boolean) AS is_st FROM mkt_state"))
def _(spark, d):
    root = _scratch(spark)
    write_sorted(mkt_state(spark, d).withColumn("is_st", F.lit(None).cast("boolean")), f"{root}/market_state", ["date", "asset"])
    return read_standard_table(spark, root, "market_state")


@query("raw_scan_required_and_optional", sql_with("raw_adj", "SELECT 'adj_factor' AS name, count(*) AS n FROM raw_adj UNION ALL SELECT 'stk_limit', 0"))
def _(spark, d):
    root = _scratch(spark)
    write_raw_table(raw_adj(spark, d), root, "adj_factor")
    found = read_raw_table(spark, root, "adj_factor", "ts_code STRING, trade_date STRING, adj_factor DOUBLE")
    absent = read_raw_table(spark, root, "stk_limit", "ts_code STRING, trade_date STRING, up_limit DOUBLE, down_limit DOUBLE", required=False)
    return found.agg(F.lit("adj_factor").alias("name"), F.count(F.lit(1)).alias("n")).unionByName(
        absent.agg(F.lit("stk_limit").alias("name"), F.count(F.lit(1)).alias("n"))
    )


@query("sorted_raw_sink", sql_with("raw_daily", "SELECT ts_code, trade_date, close, vol FROM raw_daily"))
def _(spark, d):
    root = _scratch(spark)
    write_raw_table(raw_daily(spark, d), root, "daily")
    return spark.read.parquet(f"{root}/daily").select("ts_code", "trade_date", "close", "vol")


# Contracts on whole tables with planted faults.
cte(
    "px_bad", "",
    """SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE cast(l_shipdate as date) END AS date, CASE WHEN l_suppkey % 17 = 0 THEN ' ' WHEN l_suppkey % 19 = 0 THEN NULL ELSE cast(l_suppkey as varchar) END AS asset,
    CASE WHEN l_tax >= 0.08 THEN NULL WHEN l_discount = 0 THEN -l_extendedprice ELSE l_extendedprice END AS close FROM lineitem""",
)


def px_bad(spark, d):
    s = F.col("l_suppkey")
    return table(spark, d, "lineitem").select(
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_shipdate").cast("date")).alias("date"),
        F.when(s % 17 == 0, F.lit(" ")).when(s % 19 == 0, None).otherwise(s.cast("string")).alias("asset"),
        F.when(F.col("l_tax") >= 0.08, None).when(F.col("l_discount") == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("close"),
    )


def _rules_sql(source: str, rules: dict[str, str], keys: str) -> str:
    parts = [f"SELECT 'empty_table' AS rule, cast(count(*) = 0 as bigint) AS n FROM {source}"]
    parts += [f"SELECT '{name}', count(*) FILTER ({cond}) FROM {source}" for name, cond in rules.items()]
    if keys:
        parts.append(f"SELECT 'duplicate_key', (SELECT count(*) FROM {source}) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source}))")
    return " UNION ALL ".join(parts)


_KEY_RULES = {"invalid_date": "date IS NULL", "null_asset": "asset IS NULL", "blank_asset": "trim(asset) = ''"}


@query("price_contract", sql_with("px_bad", _rules_sql("px_bad", {**_KEY_RULES, "null_close": "close IS NULL", "non_positive_close": "close <= 0"}, "date, asset")))
def _(spark, d):
    return ct.price_violations(px_bad(spark, d))


cte("sig_bad", "px_bad", "SELECT date, asset, CASE WHEN close IS NULL THEN NULL WHEN close < 0 THEN '' ELSE 'f' END AS factor, close AS value FROM px_bad")


@query(
    "signal_contract",
    sql_with(
        "sig_bad",
        _rules_sql("sig_bad", {**_KEY_RULES, "null_factor": "factor IS NULL", "blank_factor": "trim(factor) = ''"}, "date, asset, factor")
        + " UNION ALL SELECT 'all_values_null', cast(count(*) > 0 AND count(value) = 0 as bigint) FROM sig_bad",
    ),
)
def _(spark, d):
    name = F.when(F.col("close").isNull(), None).when(F.col("close") < 0, "").otherwise("f")
    return ct.signal_violations(px_bad(spark, d).select("date", "asset", name.alias("factor"), F.col("close").alias("value")))


@query("mask_contract", sql_with("px_bad", _rules_sql("px_bad", _KEY_RULES, "date, asset")))
def _(spark, d):
    return ct.mask_violations(px_bad(spark, d).withColumn("in_universe", F.lit(True)), "in_universe")


@query(
    "mask_support_mismatch",
    sql_with(
        "px mkt_state",
        """SELECT count(*) FILTER (m.asset IS NULL) AS only_left, count(*) FILTER (p.asset IS NULL) AS only_right FROM (SELECT date, asset FROM px WHERE volume > 50) p
        FULL JOIN (SELECT date, asset FROM mkt_state WHERE NOT is_limit_locked) m ON p.date = m.date AND p.asset = m.asset""",
    ),
)
def _(spark, d):
    return ct.support_mismatch(px(spark, d).where("volume > 50"), mkt_state(spark, d).where("not is_limit_locked"))


cte("lab_bad", "px_bad", "SELECT date, asset, CASE WHEN close < 0 THEN ' ' WHEN close IS NOT NULL THEN 'y' END AS label_name FROM px_bad")


@query(
    "label_contract",
    sql_with("lab_bad", _rules_sql("lab_bad", {"invalid_date": "date IS NULL", "null_asset": "asset IS NULL", "invalid_label_name": "label_name IS NULL OR trim(label_name) = ''"}, "date, asset, label_name")),
)
def _(spark, d):
    name = F.when(F.col("close") < 0, " ").when(F.col("close").isNotNull(), "y")
    return ct.label_violations(px_bad(spark, d).withColumn("label_name", name))


@query("content_fingerprint", sql_with("px", "SELECT 'px' AS \"table\", count(*) AS rows, true AS order_blind, true AS content_sensitive FROM px"))
def _(spark, d):
    df = px(spark, d)
    shuffled = df.select("volume", "close", "asset", "dollar_volume", "date").repartition(7, "volume").sortWithinPartitions(F.col("close").desc())
    changed = df.withColumn("volume", F.when((F.col("asset") == "0"), F.col("volume") + 1).otherwise(F.col("volume")))
    one, two, three = (ct.table_fingerprint(x).select("fingerprint").scalar() for x in (df, shuffled, changed))
    return ct.dataset_fingerprint({"px": df}).select("table", "rows", (one == two).alias("order_blind"), (one != three).alias("content_sensitive"))


cte("snap", "mom3", "SELECT date, asset, factor AS signal_name, value AS signal_value FROM mom3 WHERE value IS NOT NULL AND date IN (SELECT date FROM mom3 WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)")


def snapshot(spark, d):
    return ct.signal_snapshot(mom3(spark, d), quantile_assignments(mom3(spark, d), max_group=table(spark, d, "supplier").count()))


@query("signal_snapshot", sql_with("snap", "SELECT date, asset, signal_name, round(signal_value, 8) AS signal_value FROM snap"))
def _(spark, d):
    return rounded(snapshot(spark, d))


cte("mask_part", "mkt_state", "SELECT date, asset, NOT is_limit_locked AS is_tradable FROM mkt_state WHERE NOT is_halted")


def mask_part(spark, d):
    return mkt_state(spark, d).where("not is_halted").select("date", "asset", (~F.col("is_limit_locked")).alias("is_tradable"))


@query("mask_on_signal_dates", sql_with("snap mask_part", "SELECT m.* FROM mask_part m WHERE date IN (SELECT date FROM snap)"))
def _(spark, d):
    return ct.slice_to_signal_dates(mask_part(spark, d), snapshot(spark, d))


@query("label_snapshot", sql_with("snap reg3", "SELECT date, asset, label_name, label_value FROM reg3 WHERE date IN (SELECT date FROM snap)"))
def _(spark, d):
    labels = regression_forward_label(px(spark, d), horizon=3).select("date", "asset", "label_name", "label_value")
    return ct.slice_to_signal_dates(labels, snapshot(spark, d))


@query("signal_keys_missing_in_mask", sql_with("snap mask_part", "SELECT DISTINCT s.date, s.asset FROM snap s ANTI JOIN mask_part m ON s.date = m.date AND s.asset = m.asset"))
def _(spark, d):
    return ct.missing_keys(snapshot(spark, d), mask_part(spark, d))


@query(
    "exclusion_reason_coverage",
    sql_with("uni reasons", "SELECT DISTINCT u.date, u.asset FROM uni u ANTI JOIN (SELECT * FROM reasons WHERE reason <> 'halted_trading') r ON u.date = r.date AND u.asset = r.asset WHERE NOT u.is_tradable"),
)
def _(spark, d):
    from panelyard.catalog.transforms import research_universe

    out = research_universe(spark, d)
    return ct.uncovered_exclusions(out["tradability"], out["exclusion_reasons"].where("reason <> 'halted_trading'"))


@query(
    "bundle_contract",
    sql_with(
        "snap mask_part px",
        """SELECT 'missing_in_universe' AS rule, count(*) AS n FROM (SELECT DISTINCT date, asset FROM snap) s ANTI JOIN px p ON s.date = p.date AND s.asset = p.asset
        UNION ALL SELECT 'missing_in_tradability', count(*) FROM (SELECT DISTINCT date, asset FROM snap) s ANTI JOIN mask_part p ON s.date = p.date AND s.asset = p.asset
        UNION ALL SELECT 'duplicate_signal', count(*) - count(DISTINCT (date, asset)) FROM snap UNION ALL SELECT 'duplicate_universe', 0 UNION ALL SELECT 'duplicate_tradability', 0""",
    ),
)
def _(spark, d):
    return ct.bundle_violations(snapshot(spark, d), px(spark, d), mask_part(spark, d))


# Standardization.
cte("open_raw", "raw_cal", "SELECT cal_date, lower(trim(is_open)) AS t FROM raw_cal")


@query("strict_boolean", sql_with("open_raw", "SELECT cal_date, CASE WHEN t IN ('1', 'true') THEN true WHEN t IN ('0', 'false') THEN false END AS is_open FROM open_raw"))
def _(spark, d):
    return raw_cal(spark, d).select("cal_date", ct.coerce_bool("is_open").alias("is_open"))


@query("boolean_contract", sql_with("raw_daily", _rules_sql("raw_daily", {"non_boolean_vol": "lower(trim(vol)) NOT IN ('1', '0', 'true', 'false')"}, "")))
def _(spark, d):
    return ct.bool_violations(raw_daily(spark, d), "vol")


_NORM = "upper(trim(ts_code)) AS asset, coalesce(try_strptime(trade_date, '%Y%m%d'), try_strptime(trade_date, '%Y-%m-%d'))::date AS date"
cte("std_daily", "raw_daily", f"SELECT {_NORM}, close, high, low, try_cast(vol as double) * 100 AS volume, amount * 1000 AS dollar_volume FROM raw_daily")


@query("asset_and_date_normalization", sql_with("std_daily", "SELECT DISTINCT asset, date FROM std_daily"))
def _(spark, d):
    raw = raw_daily(spark, d)
    return raw.select(vendor.normalize_asset("ts_code").alias("asset"), vendor.normalize_date("trade_date").alias("date")).distinct()


@query(
    "raw_contract",
    sql_with("raw_daily", _rules_sql("raw_daily", {"blank_ts_code": "trim(ts_code) = ''", "invalid_trade_date": "false", "non_numeric_vol": "try_cast(vol as double) IS NULL"}, "")),
)
def _(spark, d):
    return vendor.raw_violations(raw_daily(spark, d), asset="ts_code", dates=("trade_date",), numbers=("vol",))


cte("std_basic", "raw_basic", f"SELECT {_NORM}, pb, total_mv, total_mv * 10000 AS total_mv_yuan FROM raw_basic")
cte("std_adj", "raw_adj", f"SELECT {_NORM}, adj_factor FROM raw_adj")
cte(
    "std_prices", "std_daily std_basic std_adj",
    """SELECT p.date, p.asset, close, high, low, volume, dollar_volume, dollar_volume AS dollar_volume_yuan, pb, total_mv_yuan, adj_factor FROM std_daily p LEFT JOIN std_basic b ON p.date = b.date AND p.asset = b.asset
    LEFT JOIN std_adj a ON p.date = a.date AND p.asset = a.asset""",
)


@query("standardized_prices", sql_with("std_prices", "SELECT * FROM std_prices"))
def _(spark, d):
    out = vendor.standardize_prices(raw_daily(spark, d), raw_basic(spark, d), raw_adj(spark, d))
    return out.drop("pe_ttm", "circ_mv_yuan")


cte(
    "std_meta", "raw_basic_info",
    """SELECT asset, listing_date, is_st, industry, name, list_status FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY listing_date DESC, list_status DESC, name DESC) AS k FROM (
    SELECT upper(trim(ts_code)) AS asset, strptime(list_date, '%Y%m%d')::date AS listing_date, contains(upper(name), 'ST') AS is_st, industry, name, list_status FROM raw_basic_info)) WHERE k = 1""",
)


@query("standardized_asset_metadata", sql_with("std_meta", "SELECT * FROM std_meta"))
def _(spark, d):
    return vendor.standardize_asset_metadata(raw_basic_info(spark, d)).select("asset", "listing_date", "is_st", "industry", "name", "list_status")


cte("std_cal", "raw_cal", "SELECT strptime(cal_date, '%Y%m%d')::date AS date, exchange, lower(trim(is_open)) IN ('1', 'true') AS is_open, strptime(pretrade_date, '%Y%m%d')::date AS pretrade_date FROM raw_cal")


@query("standardized_trade_calendar", sql_with("std_cal", "SELECT * FROM std_cal"))
def _(spark, d):
    return vendor.standardize_trade_calendar(raw_cal(spark, d))


@query("standardized_fundamentals", sql_with("std_basic", "SELECT date, asset, pb, cast(null as double) AS pe, total_mv, total_mv_yuan FROM std_basic"))
def _(spark, d):
    return vendor.standardize_daily_basic(raw_basic(spark, d)).select("date", "asset", "pb", "pe", "total_mv", "total_mv_yuan")


cte("std_fina", "raw_fina", "SELECT upper(trim(ts_code)) AS asset, strptime(ann_date, '%Y%m%d')::date AS announce_date, strptime(end_date, '%Y%m%d')::date AS report_period, roe, roe_dt, cast(null as double) AS roa FROM raw_fina")


@query("standardized_indicators", sql_with("std_fina", "SELECT * FROM std_fina"))
def _(spark, d):
    return vendor.standardize_indicators(raw_fina(spark, d)).select("asset", "announce_date", "report_period", "roe", "roe_dt", "roa")


@query("merged_indicator_sources", sql_with("raw_fina", "SELECT * FROM raw_fina WHERE roe_dt IS NULL UNION SELECT * FROM raw_fina WHERE ann_date >= '19980101'"))
def _(spark, d):
    raw = raw_fina(spark, d)
    return vendor.merge_indicator_sources(raw.where("roe_dt is null"), raw.where("ann_date >= '19980101'"))


cte(
    "std_state", "std_prices std_meta raw_suspend raw_limit",
    f"""SELECT p.date, p.asset, s.asset IS NOT NULL OR abs(coalesce(volume, 0)) <= 1e-8 AS is_halted,
    coalesce(abs(high - up_limit) <= 1e-6 OR abs(low - down_limit) <= 1e-6, false) AND coalesce(abs(close - up_limit) <= 1e-6 OR abs(close - down_limit) <= 1e-6, false) AS is_limit_locked, coalesce(is_st, false) AS is_st
    FROM std_prices p LEFT JOIN std_meta m ON p.asset = m.asset LEFT JOIN (SELECT DISTINCT {_NORM} FROM raw_suspend) s ON s.date = p.date AND s.asset = p.asset
    LEFT JOIN (SELECT {_NORM}, up_limit, down_limit FROM raw_limit) l ON l.date = p.date AND l.asset = p.asset""",
)


@query("standardized_market_state", sql_with("std_state", "SELECT * FROM std_state"))
def _(spark, d):
    prices = vendor.standardize_prices(raw_daily(spark, d), raw_basic(spark, d), raw_adj(spark, d))
    meta = vendor.standardize_asset_metadata(raw_basic_info(spark, d))
    return vendor.standardize_market_state(prices, meta, raw_suspend(spark, d), raw_limit(spark, d))


@query("open_trading_dates", sql_with("std_cal", "SELECT DISTINCT date FROM std_cal WHERE is_open AND date BETWEEN date '1996-02-01' AND date '1999-09-30'"))
def _(spark, d):
    return vendor.open_dates(raw_cal(spark, d), "1996-02-01", "1999-09-30")


@query(
    "quarter_end_periods",
    """SELECT DISTINCT last_day(cast(q as date) + interval 2 month) AS period FROM (SELECT unnest(generate_series(date_trunc('quarter', min(l_shipdate))::timestamp, max(l_shipdate)::timestamp, interval 3 month)) AS q
    FROM lineitem GROUP BY l_suppkey)""",
)
def _(spark, d):
    bounds = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.min(F.col("l_shipdate").cast("date")).alias("start"), F.max(F.col("l_shipdate").cast("date")).alias("end")
    )
    return vendor.quarter_ends(bounds)
