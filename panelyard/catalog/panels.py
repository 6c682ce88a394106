"""Panels derived from the driver tables.

Money columns are summed as whole cents, so every derived price is the same double whatever
the order of the sum. Each panel groups the whole source table by its key first; the group
is a partial aggregate, so a supplier or a month that holds a third of all lines costs no
more to the reducers than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.groups import dealt
from panelyard.functions.storage import materialize, written_rows
from panelyard.operators.factors import low_volatility, momentum, reversal
from panelyard.operators.labels import forward_return
from panelyard.sources.research_inputs import book_to_price


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.rint(F.col(column) * F.lit(100.0)).cast("long")


def exact_sum(column: str) -> Column:
    """Sum of a two-decimal column in whole cents: exact, order-free and inside code generation."""
    return F.sum(cents(column)) / F.lit(100.0)


def month(c: str) -> Column:
    return F.date_trunc("month", c).cast("date")


def assets_per_date(spark: SparkSession, sf_dir: str) -> int:
    """Upper bound of a cross-section: the supplier count, read from the file footer."""
    return table(spark, sf_dir, "supplier").count()


def _panel(lines: DataFrame, date: Column, *more: Column) -> DataFrame:
    return lines.groupBy(date.alias("date"), F.col("l_suppkey").cast("string").alias("asset")).agg(
        (exact_sum("l_extendedprice") / exact_sum("l_quantity")).alias("close"),
        exact_sum("l_quantity").alias("volume"),
        exact_sum("l_extendedprice").alias("dollar_volume"),
        *more,
    )


def _states() -> tuple[Column, Column]:
    return (
        (F.count(F.lit(1)) <= 2).alias("is_halted"),
        ((F.max("l_discount") >= 0.1) & (F.min("l_tax") == 0)).alias("is_limit_locked"),
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "lineitem"), month("l_shipdate"))


def px_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _panel(table(spark, sf_dir, "lineitem"), F.col("l_shipdate").cast("date"))


def px_evt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("ts").cast("date").alias("date"), F.col("user_id").cast("string").alias("asset"))
        .agg((exact_sum("value") / F.count(F.lit(1)).cast("double")).alias("close"))
    )


def asset_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "r_name")
    return table(spark, sf_dir, "supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").cast("string").alias("asset"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("s_suppkey") * 37 % 1500).cast("int")).alias("listing_date"),
        (F.col("s_acctbal") < 0).alias("is_st"),
        F.col("r_name").alias("industry"),
    )


def mkt_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(
        month("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("asset")
    ).agg(*_states())


def px_and_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``px`` and of ``mkt_state``, which have the same keys, from one pass over the lines."""
    return _panel(table(spark, sf_dir, "lineitem"), month("l_shipdate"), *_states())


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pb per (month, supplier), and a market value in the vendor's currency unit."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("total"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", "l_suppkey", "l_quantity")
    total = F.sum("total") / F.lit(100.0)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        month("l_shipdate").alias("date"), F.col("l_suppkey").cast("string").alias("asset")
    ).agg((total / F.count(F.lit(1)).cast("double") / exact_sum("l_quantity")).alias("pb"), total.alias("total_mv_yuan"))


def fin_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    quarter = F.date_trunc("quarter", "l_shipdate").cast("date")
    base = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("asset"), quarter.alias("q")).agg(
        (exact_sum("l_discount") / F.count(F.lit(1)).cast("double")).alias("roe")
    )
    return base.select(
        "asset",
        F.date_add(F.add_months("q", 3), 20).alias("announce_date"),
        F.col("q").alias("report_period"),
        "roe",
        F.when(F.quarter("q") % 2 == 1, F.col("roe") * 2).alias("roe_dt"),
        F.lit(None).cast("double").alias("roa"),
    )


def events_iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = W.partitionBy("asset").orderBy("date")
    return px(spark, sf_dir).select(
        F.concat_ws("|", F.date_format("date", "yyyy-MM-dd"), "asset").alias("sample_id"),
        "date",
        "asset",
        F.col("date").alias("event_start"),
        F.lead("date", 3).over(own).alias("event_end"),
        (F.lead("close", 3).over(own) / F.col("close") - 1).alias("v"),
    )


def mom3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return momentum(px(spark, sf_dir), window=3)


def fwd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forward_return(px(spark, sf_dir), horizon=1)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three factors in long form."""
    return signals_of(px(spark, sf_dir), fundamentals(spark, sf_dir))


def signals_of(prices: DataFrame, values: DataFrame) -> DataFrame:
    return (
        reversal(prices, window=2)
        .unionByName(low_volatility(prices, window=4))
        .unionByName(book_to_price(values))
    )


def stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signal table written once, for queries that read it from several branches."""
    return materialize(signals(spark, sf_dir))


def signals_and_label(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signal table, the next return and the prices of both, all written; prices are taken from the lines once."""
    prices = materialize(px(spark, sf_dir))
    own = dealt(prices, ["asset"], written_rows(prices))
    return materialize(signals_of(own, fundamentals(spark, sf_dir))), materialize(forward_return(own, horizon=1)), prices


# The same panels for the SQL engine of the correctness check.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, deps: str, sql: str) -> None:
    _CTES[name] = (tuple(deps.split()), sql.strip())


def sql_with(names: str, final: str) -> str:
    """``final`` preceded by the named CTEs and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names.split():
        visit(n)
    body = ",\n".join(f"{n} AS ({_CTES[n][1]})" for n in order)
    return f"WITH RECURSIVE {body}\n{final.strip()}" if body else final.strip()


def _sum(c: str) -> str:
    return f"cast(sum(cast({c} as decimal(18,2))) as double)"


def _px_sql(date: str) -> str:
    return (
        f"SELECT {date} AS date, cast(l_suppkey as varchar) AS asset, "
        f"{_sum('l_extendedprice')} / {_sum('l_quantity')} AS close, {_sum('l_quantity')} AS volume, "
        f"{_sum('l_extendedprice')} AS dollar_volume FROM lineitem GROUP BY 1, 2"
    )


MONTH_SQL = "cast(date_trunc('month', l_shipdate) as date)"
cte("px", "", _px_sql(MONTH_SQL))
cte("px_gap", "", _px_sql("cast(l_shipdate as date)"))
cte("px_evt", "", f"SELECT cast(ts as date) AS date, cast(user_id as varchar) AS asset, {_sum('value')} / cast(count(*) as double) AS close FROM events GROUP BY 1, 2")
cte(
    "asset_meta", "",
    "SELECT cast(s_suppkey as varchar) AS asset, cast(date '1995-01-01' + cast(s_suppkey * 37 % 1500 as integer) as date) AS listing_date, "
    "s_acctbal < 0 AS is_st, r_name AS industry FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey",
)
cte(
    "mkt_state", "",
    f"SELECT {MONTH_SQL} AS date, cast(l_suppkey as varchar) AS asset, count(*) <= 2 AS is_halted, "
    "max(l_discount) >= cast(0.1 as double) AND min(l_tax) = 0 AS is_limit_locked FROM lineitem GROUP BY 1, 2",
)
cte(
    "fundamentals", "",
    f"SELECT {MONTH_SQL} AS date, cast(l_suppkey as varchar) AS asset, "
    f"{_sum('o_totalprice')} / cast(count(*) as double) / {_sum('l_quantity')} AS pb, {_sum('o_totalprice')} AS total_mv_yuan "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
)
cte(
    "fin_ann", "",
    "SELECT asset, cast(q + interval 3 month + interval 20 day as date) AS announce_date, q AS report_period, roe, "
    "CASE WHEN quarter(q) % 2 = 1 THEN roe * 2 END AS roe_dt, cast(null as double) AS roa FROM ("
    "SELECT cast(l_suppkey as varchar) AS asset, cast(date_trunc('quarter', l_shipdate) as date) AS q, "
    f"{_sum('l_discount')} / cast(count(*) as double) AS roe FROM lineitem GROUP BY 1, 2)",
)
cte(
    "events_iv", "px",
    "SELECT strftime(date, '%Y-%m-%d') || '|' || asset AS sample_id, date, asset, date AS event_start, lead(date, 3) OVER w AS event_end, "
    "lead(close, 3) OVER w / close - 1 AS v FROM px WINDOW w AS (PARTITION BY asset ORDER BY date)",
)


def momentum_sql(source: str, window: int, sign: str = "", name: str | None = None, min_periods: int | None = None) -> str:
    need = window + 1 if min_periods is None else min_periods
    return (
        f"SELECT date, asset, '{name or f'momentum_{window}d'}' AS factor, CASE WHEN count(close) OVER (PARTITION BY asset ORDER BY date "
        f"ROWS BETWEEN {window} PRECEDING AND CURRENT ROW) >= {need} THEN {sign}(close / lag(close, {window}) OVER (PARTITION BY asset ORDER BY date) - 1) END AS value FROM {source}"
    )


def low_vol_sql(source: str, window: int) -> str:
    return (
        f"SELECT date, asset, 'low_volatility_{window}d' AS factor, CASE WHEN count(r) OVER f >= {window} THEN -stddev_samp(r) OVER f END AS value FROM ("
        f"SELECT date, asset, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM {source}) "
        f"WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    )


def fwd_sql(source: str, h: int) -> str:
    return f"SELECT date, asset, 'forward_return_{h}' AS factor, lead(close, {h}) OVER (PARTITION BY asset ORDER BY date) / close - 1 AS value FROM {source}"


def avg_rank_sql(keys: str, value: str) -> str:
    """Average rank of non-null values; to be used over rows that all have a value."""
    return f"(rank() OVER (PARTITION BY {keys} ORDER BY {value}) + (count(*) OVER (PARTITION BY {keys}, {value}) - 1) * cast(0.5 as double))"


def corr_sql(x: str, y: str, n: int = 2) -> str:
    """Guarded correlation over rows that are complete pairs."""
    return f"CASE WHEN count(*) >= {n} AND min({x}) < max({x}) AND min({y}) < max({y}) THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


cte("mom3", "px", momentum_sql("px", 3))
cte("fwd1", "px", fwd_sql("px", 1))
cte("rev2", "px", momentum_sql("px", 2, "-", "reversal_2d"))
cte("lv4", "px", low_vol_sql("px", 4))
cte("bp", "fundamentals", "SELECT date, asset, 'value_book_to_price_proxy' AS factor, CASE WHEN pb > 0 THEN cast(1 as double) / pb END AS value FROM fundamentals")
cte("signals", "rev2 lv4 bp", "SELECT * FROM rev2 UNION ALL SELECT * FROM lv4 UNION ALL SELECT * FROM bp")
cte("dates", "px", "SELECT date, row_number() OVER (ORDER BY date) AS t FROM (SELECT DISTINCT date FROM px)")
