"""Cross-sectional transforms, neutralization and the research universe."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.panels import (
    asset_meta, assets_per_date, avg_rank_sql, corr_sql, cte, fundamentals, mkt_state, mom3, px, px_evt, signals, sql_with,
)
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.functions.storage import materialize
from panelyard.operators import neutralization, transforms, universe
from panelyard.sources.research_inputs import neutralization_exposures

cte("mom5e", "px_evt", "SELECT date, asset, close AS value FROM px_evt")


@query(
    "winsorize_whole_column",
    sql_with("mom5e", "SELECT date, asset, round(greatest(least(value, quantile_cont(value, 0.95) OVER ()), quantile_cont(value, 0.05) OVER ()), 8) AS value FROM mom5e"),
)
def _(spark, d):
    # A small split bound sends the whole-column order through the range-split strategy.
    from panelyard.functions.groups import group_quantiles

    df = px_evt(spark, d).select("date", "asset", F.col("close").alias("value"))
    bounds = group_quantiles(df.withColumn("k", F.lit(1)), ["k"], F.col("value"), (0.05, 0.95), ("lo", "hi"), split_rows=500)
    out = df.withColumn("b", bounds.select(F.struct("lo", "hi")).scalar())
    return rounded(out.select("date", "asset", F.greatest(F.least("value", F.col("b.hi")), F.col("b.lo")).alias("value")))


@query("zscore_whole_column", sql_with("mom5e", "SELECT date, asset, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 7) AS value FROM mom5e"))
def _(spark, d):
    return rounded(transforms.zscore_series(px_evt(spark, d).select("date", "asset", F.col("close").alias("value"))), 7)


@query(
    "winsorize_cross_section",
    sql_with(
        "signals",
        """SELECT date, asset, factor, round(CASE WHEN count(value) OVER w < 3 THEN value WHEN value IS NOT NULL THEN
        greatest(least(value, quantile_cont(value, 0.95) OVER w), quantile_cont(value, 0.05) OVER w) END, 7) AS value FROM signals WINDOW w AS (PARTITION BY date, factor)""",
    ),
)
def _(spark, d):
    return rounded(transforms.winsorize_cross_section(signals(spark, d), lower=0.05, upper=0.95, max_group=assets_per_date(spark, d)), 7)


_Z = """CASE WHEN count(value) OVER w >= 3 THEN CASE WHEN min(value) OVER w = max(value) OVER w THEN cast(0 as double)
 ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END END"""
cte("zsig", "signals", f"SELECT date, asset, factor, {_Z} AS value FROM signals WINDOW w AS (PARTITION BY date, factor)")


@query("zscore_cross_section", sql_with("zsig", "SELECT date, asset, factor, round(value, 7) AS value FROM zsig"))
def _(spark, d):
    return rounded(transforms.zscore_cross_section(signals(spark, d), max_group=assets_per_date(spark, d)), 7)


@query(
    "zscore_pooled_by_date",
    sql_with("signals", f"SELECT date, asset, factor, round({_Z}, 7) AS value FROM signals WINDOW w AS (PARTITION BY date)"),
)
def _(spark, d):
    # No bound is passed: the statistics come from a partial aggregate joined back to the rows.
    return rounded(transforms.zscore_cross_section(signals(spark, d), by=("date",)), 7)


_RANKED = f"""SELECT s.date, s.asset, s.factor, CASE WHEN n >= 2 THEN r / n END AS value FROM signals s LEFT JOIN (
 SELECT date, asset, factor, {avg_rank_sql('date, factor', 'value')} AS r, count(*) OVER (PARTITION BY date, factor) AS n FROM signals WHERE value IS NOT NULL) k
 ON s.date = k.date AND s.asset = k.asset AND s.factor = k.factor"""


@query("rank_cross_section", sql_with("signals", _RANKED))
def _(spark, d):
    return transforms.rank_cross_section(signals(spark, d), max_group=assets_per_date(spark, d))


@query("rank_cross_section_range_split", sql_with("signals", _RANKED))
def _(spark, d):
    # The same operator with oversized groups cut into value ranges of about 16 rows.
    return transforms.rank_cross_section(signals(spark, d), split_rows=16)


cte("sig_ind", "signals asset_meta", "SELECT s.*, industry FROM signals s LEFT JOIN asset_meta a ON s.asset = a.asset")


@query(
    "demean_by_industry",
    sql_with(
        "sig_ind",
        """SELECT date, asset, factor, industry, round(CASE WHEN industry IS NOT NULL AND count(value) OVER w >= 3 THEN value - avg(value) OVER w END, 8) AS value
        FROM sig_ind WINDOW w AS (PARTITION BY date, factor, industry)""",
    ),
)
def _(spark, d):
    df = signals(spark, d).join(asset_meta(spark, d).select("asset", "industry"), "asset", "left")
    return rounded(transforms.neutralize_by_group(df, group_col="industry").select("date", "asset", "factor", "industry", "value"))


@query(
    "min_coverage_gate",
    sql_with("signals", "SELECT date, asset, factor, round(value, 8) AS value FROM signals QUALIFY count(value) OVER (PARTITION BY date, factor) / cast(count(*) OVER (PARTITION BY date, factor) as double) >= 0.9"),
)
def _(spark, d):
    return rounded(transforms.apply_min_coverage_gate(signals(spark, d), min_coverage=0.9).select("date", "asset", "factor", "value"))


# Universe: listing age, ST, halts, limits and an ADV floor.
RULES = universe.UniverseRules(min_listing_age_days=365, min_adv=100000.0, adv_window=6)
cte(
    "uni", "px asset_meta mkt_state",
    """SELECT *, in_universe AND NOT is_halted AND NOT is_limit_locked AND coalesce(adv, 0) >= 100000.0 AS is_tradable FROM (
    SELECT p.date, p.asset, adv, coalesce(date_diff('day', listing_date, p.date) >= 365, false) AS listing_ok, coalesce(is_st, false) AS is_st,
    coalesce(is_halted, false) AS is_halted, coalesce(is_limit_locked, false) AS is_limit_locked,
    coalesce(date_diff('day', listing_date, p.date) >= 365, false) AND NOT coalesce(is_st, false) AS in_universe FROM (
    SELECT date, asset, avg(dollar_volume) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS adv FROM px) p
    LEFT JOIN asset_meta a ON p.asset = a.asset LEFT JOIN mkt_state m ON p.date = m.date AND p.asset = m.asset)""",
)


def research_universe(spark, d, prices=None, state=None):
    return universe.construct_research_universe(
        px(spark, d) if prices is None else prices, asset_metadata=asset_meta(spark, d), market_state=mkt_state(spark, d) if state is None else state, rules=RULES
    )


@query("average_dollar_volume", sql_with("uni", "SELECT date, asset, round(adv, 4) AS adv_dollar_volume FROM uni"))
def _(spark, d):
    return rounded(universe.adv_table(px(spark, d), window=6), 4)


@query("research_universe", sql_with("uni", "SELECT date, asset, in_universe, is_tradable FROM uni"))
def _(spark, d):
    out = research_universe(spark, d)
    return out["universe"].join(out["tradability"], ["date", "asset"])


cte(
    "reasons", "uni",
    """SELECT date, asset, 'listing_age_or_missing_listing_date' AS reason, 'min_listing_age_days=365' AS detail FROM uni WHERE NOT listing_ok
    UNION ALL SELECT date, asset, 'st_filter', 'asset flagged as ST' FROM uni WHERE is_st
    UNION ALL SELECT date, asset, 'halted_trading', 'is_halted=true' FROM uni WHERE in_universe AND is_halted
    UNION ALL SELECT date, asset, 'limit_locked_non_executable', 'is_limit_locked=true' FROM uni WHERE in_universe AND NOT is_halted AND is_limit_locked
    UNION ALL SELECT date, asset, 'min_adv_filter', 'min_adv=100000.0' FROM uni WHERE in_universe AND NOT is_halted AND NOT is_limit_locked AND coalesce(adv, 0) < 100000.0""",
)


@query("exclusion_reasons", sql_with("reasons", "SELECT * FROM reasons"))
def _(spark, d):
    return research_universe(spark, d)["exclusion_reasons"]


@query(
    "universe_diagnostics",
    sql_with(
        "uni",
        """SELECT date, count(DISTINCT asset) AS n_assets, count(*) FILTER (in_universe) AS n_in_universe, count(*) FILTER (is_tradable) AS n_tradable,
        count(*) FILTER (in_universe) / cast(count(DISTINCT asset) as double) AS universe_ratio, count(*) FILTER (is_tradable) / cast(count(DISTINCT asset) as double) AS tradable_ratio
        FROM uni GROUP BY date""",
    ),
)
def _(spark, d):
    return research_universe(spark, d)["diagnostics"]


cte("masked", "signals uni", "SELECT s.date, s.asset, s.factor, CASE WHEN coalesce(in_universe, false) AND coalesce(is_tradable, false) THEN value END AS value FROM signals s LEFT JOIN uni u ON s.date = u.date AND s.asset = u.asset")


@query("universe_mask", sql_with("masked", "SELECT date, asset, factor, round(value, 8) AS value FROM masked"))
def _(spark, d):
    out = research_universe(spark, d)
    return rounded(transforms.apply_universe_mask(signals(spark, d), out["universe"], out["tradability"]))


cte(
    "prep", "masked",
    """SELECT date, asset, factor, CASE WHEN count(value) OVER w >= 5 THEN CASE WHEN min(value) OVER w = max(value) OVER w THEN cast(0 as double)
     ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END END AS value FROM (
     SELECT date, asset, factor, CASE WHEN count(value) OVER w < 5 THEN value WHEN value IS NOT NULL THEN
     greatest(least(value, quantile_cont(value, 0.98) OVER w), quantile_cont(value, 0.02) OVER w) END AS value FROM masked WINDOW w AS (PARTITION BY date, factor))
     WINDOW w AS (PARTITION BY date, factor)""",
)
cte("prep_gate", "prep", "SELECT * FROM prep QUALIFY count(value) OVER (PARTITION BY date, factor) / cast(count(*) OVER (PARTITION BY date, factor) as double) >= 0.2")
PREP = dict(lower=0.02, upper=0.98, min_group_size=5, min_coverage=0.2)


@query("preprocess_chain", sql_with("prep_gate", "SELECT date, asset, factor, round(value, 6) AS value FROM prep_gate"))
def _(spark, d):
    out = research_universe(spark, d)
    masked = transforms.apply_universe_mask(signals(spark, d), out["universe"], out["tradability"])
    return rounded(transforms.apply_preprocess(masked, max_group=assets_per_date(spark, d), **PREP), 6)


# Exposures joined to momentum; region is the industry.
cte(
    "expo", "px fundamentals beta asset_meta",
    """SELECT b.date, b.asset, CASE WHEN total_mv_yuan > 0 THEN ln(total_mv_yuan) END AS size_exposure, beta_exposure, industry
    FROM beta b LEFT JOIN fundamentals f ON b.date = f.date AND b.asset = f.asset LEFT JOIN asset_meta a ON b.asset = a.asset""",
)
cte("nin", "mom3 expo", "SELECT m.date, m.asset, m.factor, value, size_exposure, beta_exposure, industry FROM mom3 m LEFT JOIN expo e ON m.date = e.date AND m.asset = e.asset")
cte("ncat", "nin", "SELECT min(industry) AS first, count(DISTINCT industry) AS n FROM nin")
cte(
    "nval", "nin ncat",
    "SELECT date, asset, value AS y, size_exposure AS s, beta_exposure AS b, coalesce(industry, first) AS g, n AS cats FROM nin, ncat WHERE value IS NOT NULL AND size_exposure IS NOT NULL AND beta_exposure IS NOT NULL",
)
cte(
    "nmom", "nval",
    """SELECT date, g, any_value(cats) AS cats, count(*) AS n, avg(y) AS my, avg(s) AS ms, avg(b) AS mb, count(*) * var_pop(s) AS ss, count(*) * var_pop(b) AS bb,
    count(*) * covar_pop(s, b) AS sb, count(*) * covar_pop(s, y) AS sy, count(*) * covar_pop(b, y) AS byy FROM nval GROUP BY date, g""",
)
cte(
    "nslope", "nmom",
    """SELECT date, sum(n) AS n_obs, any_value(cats) AS cats, (sum(sy) * sum(bb) - sum(byy) * sum(sb)) / (sum(ss) * sum(bb) - sum(sb) * sum(sb)) AS bs,
    (sum(byy) * sum(ss) - sum(sy) * sum(sb)) / (sum(ss) * sum(bb) - sum(sb) * sum(sb)) AS bbeta FROM nmom GROUP BY date
    HAVING sum(n) >= greatest(20, 2 + any_value(cats) - 1 + 2)""",
)
cte("nlevel", "nmom nslope", "SELECT m.date, m.g, s.bs, s.bbeta, my - s.bs * ms - s.bbeta * mb AS level FROM nmom m JOIN nslope s ON m.date = s.date")
cte(
    "nres", "nin nval nlevel",
    """SELECT i.date, i.asset, i.value, i.size_exposure, i.beta_exposure, i.industry, r.res AS value_neutralized FROM nin i LEFT JOIN (
    SELECT v.date, v.asset, y - level - bs * s - bbeta * b AS res FROM nval v JOIN nlevel l ON v.date = l.date AND v.g = l.g) r ON i.date = r.date AND i.asset = r.asset""",
)


def neutralization_input(spark, d):
    n = assets_per_date(spark, d)
    expo = neutralization_exposures(px(spark, d), fundamentals(spark, d), asset_meta(spark, d), window=12, min_periods=8, max_group=n)
    # The regression reads its input several times (moments, residuals, diagnostics).
    return materialize(mom3(spark, d).join(expo, ["date", "asset"], "left"))


_COLS = dict(size_col="size_exposure", beta_col="beta_exposure", industry_col="industry")


@query("regression_neutralization", sql_with("nres", "SELECT date, asset, round(value_neutralized, 6) AS value_neutralized FROM nres"))
def _(spark, d):
    out = neutralization.neutralize_signal(neutralization_input(spark, d), **_COLS)
    return rounded(out["data"].select("date", "asset", "value_neutralized"), 6)


@query("regression_neutralization_ridge", sql_with("nres", "SELECT date, asset, round(value_neutralized, 4) AS value_neutralized FROM nres"))
def _(spark, d):
    # The penalized normal equations at the default ridge agree with the exact fit to 4 digits.
    out = neutralization.neutralize_signal(neutralization_input(spark, d), solver="ridge", ridge=1e-12, **_COLS)
    return rounded(out["data"].select("date", "asset", "value_neutralized"), 4)


@query(
    "neutralization_coefficients",
    sql_with(
        "nlevel ncat",
        """, head AS (SELECT date, coalesce(max(level) FILTER (g = first), sum(level) / (count(*) + 1)) AS intercept, max(bs) AS bs, max(bbeta) AS bbeta FROM nlevel, ncat GROUP BY date)
        SELECT date, exposure, round(c, 5) AS coefficient FROM (SELECT date, 'intercept' AS exposure, intercept AS c FROM head UNION ALL SELECT date, 'size_exposure', bs FROM head
        UNION ALL SELECT date, 'beta_exposure', bbeta FROM head UNION ALL SELECT l.date, 'industry_' || g, level - intercept FROM nlevel l JOIN head h ON l.date = h.date, ncat WHERE g <> first)""",
    ),
)
def _(spark, d):
    return rounded(neutralization.neutralize_signal(neutralization_input(spark, d), **_COLS)["coefficients"], 5)


@query(
    "size_neutralization",
    sql_with(
        "nin",
        """SELECT i.date, i.asset, round(value - (my - b * ms) - b * size_exposure, 7) AS value_neutralized FROM nin i LEFT JOIN (
        SELECT date, avg(value) AS my, avg(size_exposure) AS ms, covar_pop(size_exposure, value) / var_pop(size_exposure) AS b FROM nin
        WHERE value IS NOT NULL AND size_exposure IS NOT NULL GROUP BY date HAVING count(*) >= 20) f ON i.date = f.date""",
    ),
)
def _(spark, d):
    out = neutralization.neutralize_size(neutralization_input(spark, d), size_col="size_exposure")
    return rounded(out["data"].select("date", "asset", "value_neutralized"), 7)


@query(
    "size_neutralization_ridge",
    sql_with(
        "nin",
        """SELECT i.date, i.asset, round(value - a - b * size_exposure, 7) AS value_neutralized FROM nin i LEFT JOIN (
        SELECT date, (sy * (sxx + 25) - sx * sxy) / ((n + 25) * (sxx + 25) - sx * sx) AS a, ((n + 25) * sxy - sx * sy) / ((n + 25) * (sxx + 25) - sx * sx) AS b FROM (
        SELECT date, count(*) AS n, sum(size_exposure) AS sx, sum(size_exposure * size_exposure) AS sxx, sum(value) AS sy, sum(size_exposure * value) AS sxy FROM nin
        WHERE value IS NOT NULL AND size_exposure IS NOT NULL GROUP BY date HAVING count(*) >= 20)) f ON i.date = f.date""",
    ),
)
def _(spark, d):
    out = neutralization.neutralize_size(neutralization_input(spark, d), size_col="size_exposure", ridge=25.0)
    return rounded(out["data"].select("date", "asset", "value_neutralized"), 7)


cte(
    "nlong", "nres",
    """SELECT date, value AS b, value_neutralized AS a, 'size_exposure' AS exposure, size_exposure AS x FROM nres UNION ALL SELECT date, value, value_neutralized, 'beta_exposure', beta_exposure FROM nres
    UNION ALL SELECT date, value, value_neutralized, 'industry_' || c, CASE WHEN coalesce(industry, (SELECT first FROM ncat)) = c THEN 1.0 ELSE 0.0 END FROM nres, (SELECT DISTINCT industry AS c FROM nres WHERE industry > (SELECT first FROM ncat))""",
)


@query(
    "exposure_diagnostics",
    sql_with(
        "nlong",
        f"""SELECT exposure, round(avg(abs(cb)), 6) AS mean_abs_corr_before, round(avg(CASE WHEN abs(ca) < 1e-9 THEN 0 ELSE abs(ca) END), 6) AS mean_abs_corr_after,
        round(avg(abs(cb)) - avg(abs(ca)), 6) AS corr_reduction, least(count(cb), count(ca)) AS n_dates_used FROM (
        SELECT date, exposure, {corr_sql('b', 'x', 3)} AS cb, {corr_sql('a', 'x', 3)} AS ca FROM (SELECT date, exposure, b, a, cast(x as double) AS x FROM nlong) WHERE a IS NOT NULL AND b IS NOT NULL AND x IS NOT NULL GROUP BY date, exposure)
        GROUP BY exposure""",
    ),
)
def _(spark, d):
    return rounded(neutralization.neutralize_signal(neutralization_input(spark, d), **_COLS)["diagnostics"], 6)
