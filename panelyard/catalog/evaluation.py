"""Factor evaluation: correlations, buckets, turnover, decay."""

from __future__ import annotations

from panelyard.catalog.panels import assets_per_date, avg_rank_sql, corr_sql, cte, fwd1, fwd_sql, mom3, px, signals, signals_and_label, sql_with, stored_signals
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.operators import evaluation as ev
from panelyard.operators.labels import forward_return

H = (1, 2, 5, 10, 20)


def pair_ctes(prefix: str, factors: str, labels: str) -> None:
    """CTEs <prefix>_pairs, _rank (per-date IC and rank IC), _q (buckets on pairs), _qr, _ls."""
    cte(
        f"{prefix}_pairs", f"{factors} {labels}",
        f"SELECT f.date, f.asset, f.factor, y.factor AS label, f.value AS x, y.value AS y FROM {factors} f JOIN {labels} y ON f.date = y.date AND f.asset = y.asset",
    )
    metric_ctes(prefix)


def metric_ctes(prefix: str) -> None:
    """The metrics of an existing <prefix>_pairs CTE."""
    cte(
        f"{prefix}_ic", f"{prefix}_pairs",
        f"""SELECT d.date, d.factor, d.label, ic, rank_ic FROM (SELECT DISTINCT date, factor, label FROM {prefix}_pairs) d LEFT JOIN (
        SELECT date, factor, {corr_sql('x', 'y')} AS ic, {corr_sql('rx', 'ry')} AS rank_ic FROM (
        SELECT date, factor, x, y, {avg_rank_sql('date, factor', 'x')} AS rx, {avg_rank_sql('date, factor', 'y')} AS ry FROM {prefix}_pairs WHERE x IS NOT NULL AND y IS NOT NULL)
        GROUP BY date, factor) c ON d.date = c.date AND d.factor = c.factor""",
    )
    bucket_cte(f"{prefix}_q", f"{prefix}_pairs", "x", "WHERE x IS NOT NULL AND y IS NOT NULL")
    cte(f"{prefix}_qr", f"{prefix}_q", f"SELECT date, factor, quantile, avg(y) AS mean_return FROM {prefix}_q GROUP BY 1, 2, 3")
    cte(
        f"{prefix}_ls", f"{prefix}_qr",
        f"SELECT date, factor, CASE WHEN min(quantile) < max(quantile) THEN arg_max(mean_return, quantile) - arg_min(mean_return, quantile) END AS long_short_return FROM {prefix}_qr GROUP BY 1, 2",
    )


def bucket_cte(name: str, source: str, value: str, where: str, keys: str = "date, factor", n: int = 5) -> None:
    cte(
        name, source,
        f"""SELECT * EXCLUDE (r, m, u), cast(CASE WHEN u = 1 THEN 1 ELSE (2 * (r - 1) * (least({n}, m) - 1) + 3 * (u - 1)) // (2 * (u - 1)) END as integer) AS quantile FROM (
        SELECT *, max(r) OVER (PARTITION BY {keys}) AS u FROM (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY {value}) AS r, count(*) OVER (PARTITION BY {keys}) AS m FROM {source} {where}))
        WHERE m >= 2""",
    )


def turnover_ctes(prefix: str, assignments: str, keys: str = "factor") -> None:
    """CTEs <prefix>_qto and <prefix>_lsto from (keys, date, asset, quantile)."""
    same = " AND ".join(f"a.{k.strip()} = p.{k.strip()}" for k in keys.split(","))
    same_d = " AND ".join(f"a.{k.strip()} = d.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    cte(
        f"{prefix}_qto", assignments,
        f"""SELECT a.date, {ak}, a.quantile, CASE WHEN any_value(d.prev) IS NOT NULL THEN (count(*) - count(p.asset)) / cast(count(*) as double) END AS turnover FROM {assignments} a
        JOIN (SELECT {keys}, date, lag(date) OVER (PARTITION BY {keys} ORDER BY date) AS prev FROM (SELECT DISTINCT {keys}, date FROM {assignments})) d ON {same_d} AND a.date = d.date
        LEFT JOIN {assignments} p ON {same} AND p.date = d.prev AND p.asset = a.asset AND p.quantile = a.quantile GROUP BY a.date, {ak}, a.quantile""",
    )
    cte(
        f"{prefix}_lsto", f"{prefix}_qto",
        f"SELECT date, {keys}, CASE WHEN min(quantile) < max(quantile) THEN (arg_min_null(turnover, quantile) + arg_max_null(turnover, quantile)) / cast(2 as double) END AS long_short_turnover FROM {prefix}_qto GROUP BY date, {keys}",
    )


pair_ctes("mom", "mom3", "fwd1")
pair_ctes("sig", "signals", "fwd1")
bucket_cte("mom_asgn", "mom3", "value", "WHERE value IS NOT NULL")
bucket_cte("sig_asgn", "signals", "value", "WHERE value IS NOT NULL")
turnover_ctes("mom", "mom_asgn")
turnover_ctes("sig", "sig_asgn")


@query("pearson_ic", sql_with("sig_ic", "SELECT date, factor, label, round(ic, 8) AS ic FROM sig_ic"))
def _(spark, d):
    return rounded(ev.compute_ic(signals(spark, d), fwd1(spark, d)))


@query("rank_ic", sql_with("sig_ic", "SELECT date, factor, label, round(rank_ic, 8) AS rank_ic FROM sig_ic"))
def _(spark, d):
    return rounded(ev.compute_rank_ic(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d)))


@query("rank_ic_range_split", sql_with("mom_ic", "SELECT date, factor, label, round(rank_ic, 8) AS rank_ic FROM mom_ic"))
def _(spark, d):
    # Cross-sections above 24 rows are ranked range by range.
    return rounded(ev.compute_rank_ic(mom3(spark, d), fwd1(spark, d), split_rows=24))


cte(
    "sig_ics", "sig_ic",
    """SELECT factor, metric, mean, std, mean / nullif(std, 0) AS ic_ir, mean / nullif(std, 0) * sqrt(cast(n_obs as double)) AS t_stat, n_obs FROM (
    SELECT factor, 'ic' AS metric, avg(ic) AS mean, stddev_samp(ic) AS std, count(ic) AS n_obs FROM sig_ic GROUP BY factor
    UNION ALL SELECT factor, 'rank_ic', avg(rank_ic), stddev_samp(rank_ic), count(rank_ic) FROM sig_ic GROUP BY factor)""",
)
_R = "round(mean, 8) AS mean, round(std, 8) AS std, round(ic_ir, 7) AS ic_ir, round(t_stat, 6) AS t_stat, n_obs"


@query("ic_summary", sql_with("sig_ics", f"SELECT factor, metric, {_R} FROM sig_ics"))
def _(spark, d):
    n = assets_per_date(spark, d)
    pairs = ev.align(stored_signals(spark, d), fwd1(spark, d))
    keys = ["date", "factor", "label"]
    ic = ev.compute_ic_summary(ev.ic_of_pairs(pairs, keys), value_col="ic", by=("factor",))
    rank = ev.compute_ic_summary(ev.rank_ic_of_pairs(pairs, keys, max_group=n), value_col="rank_ic", by=("factor",))
    return rounded(ic.unionByName(rank), 8, ic_ir=7, t_stat=6)


@query(
    "rank_ic_summary",
    sql_with(
        "mom_ic",
        f"""SELECT 'rank_ic' AS metric, {_R} FROM (SELECT mean, std, mean / std AS ic_ir, mean / std * sqrt(cast(n_obs as double)) AS t_stat, n_obs FROM (
        SELECT avg(rank_ic) AS mean, stddev_samp(rank_ic) AS std, count(rank_ic) AS n_obs FROM mom_ic))""",
    ),
)
def _(spark, d):
    ic = ev.compute_rank_ic(mom3(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d))
    return rounded(ev.compute_ic_summary(ic, value_col="rank_ic"), 8, ic_ir=7, t_stat=6)


@query(
    "rolling_rank_ic",
    sql_with(
        "sig_ic",
        """SELECT date, factor, round(CASE WHEN count(rank_ic) OVER w >= 5 THEN avg(rank_ic) OVER w END, 8) AS rolling_rank_ic FROM sig_ic
        WINDOW w AS (PARTITION BY factor ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""",
    ),
)
def _(spark, d):
    ic = ev.compute_rank_ic(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d))
    return rounded(ev.compute_rolling_ic(ic, value_col="rank_ic", window=12))


@query(
    "coverage_by_date",
    sql_with(
        "mom3 fwd1",
        """SELECT date, nf AS n_factor_assets, ny AS n_label_assets, nb AS n_overlap_assets, nb / nullif(cast(nf as double), 0) AS coverage_overlap_vs_factor FROM (
        SELECT coalesce(f.date, y.date) AS date, count(f.asset) AS nf, count(y.asset) AS ny, count(*) FILTER (f.asset IS NOT NULL AND y.asset IS NOT NULL) AS nb
        FROM (SELECT * FROM mom3 WHERE value IS NOT NULL) f FULL JOIN (SELECT * FROM fwd1 WHERE value IS NOT NULL) y ON f.date = y.date AND f.asset = y.asset GROUP BY 1)""",
    ),
)
def _(spark, d):
    return ev.coverage_by_date(mom3(spark, d), fwd1(spark, d))


@query("quantile_assignments", sql_with("mom_asgn", "SELECT date, asset, factor, quantile FROM mom_asgn"))
def _(spark, d):
    return ev.quantile_assignments(mom3(spark, d), 5, max_group=assets_per_date(spark, d))


@query("quantile_assignments_range_split", sql_with("mom_asgn", "SELECT date, asset, factor, quantile FROM mom_asgn"))
def _(spark, d):
    return ev.quantile_assignments(mom3(spark, d), 5, split_rows=24)


@query("quantile_returns", sql_with("sig_qr", "SELECT date, factor, quantile, round(mean_return, 8) AS mean_return FROM sig_qr"))
def _(spark, d):
    return rounded(ev.quantile_returns(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d)))


@query("long_short_return", sql_with("sig_ls", "SELECT date, factor, round(long_short_return, 8) AS long_short_return FROM sig_ls"))
def _(spark, d):
    return rounded(ev.long_short_return(ev.quantile_returns(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d))))


@query(
    "quantile_monotonicity",
    sql_with(
        "sig_qr",
        f"""SELECT date, factor, count(*) AS n_quantiles_present, round({corr_sql('q', 'r')}, 8) AS rank_corr_quantile_return,
        coalesce(bool_and(s >= 0) OR bool_and(s <= 0), false) AS is_monotonic FROM (SELECT date, factor, cast(quantile as double) AS q, {avg_rank_sql('date, factor', 'mean_return')} AS r,
        mean_return - lag(mean_return) OVER (PARTITION BY date, factor ORDER BY quantile) AS s FROM sig_qr) GROUP BY 1, 2""",
    ),
)
def _(spark, d):
    return rounded(ev.quantile_monotonicity(ev.quantile_returns(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d))))


@query("quantile_turnover", sql_with("sig_qto", "SELECT date, factor, quantile, round(turnover, 10) AS turnover FROM sig_qto"))
def _(spark, d):
    return rounded(ev.quantile_turnover(ev.quantile_assignments(signals(spark, d), max_group=assets_per_date(spark, d))), 10)


@query("long_short_turnover", sql_with("sig_lsto", "SELECT date, factor, round(long_short_turnover, 10) AS long_short_turnover FROM sig_lsto"))
def _(spark, d):
    assigned = ev.quantile_assignments(signals(spark, d), max_group=assets_per_date(spark, d))
    return rounded(ev.long_short_turnover(ev.quantile_turnover(assigned)), 10)


cte("decay_y", "px", " UNION ALL ".join(f"SELECT date, asset, {h} AS horizon, value AS y FROM ({fwd_sql('px', h)})" for h in H))
cte(
    "decay", "signals decay_y",
    f"""SELECT factor, cast(horizon as integer) AS horizon, avg(c) AS mean_rank_ic, count(c) AS n_obs FROM (SELECT date, factor, horizon, {corr_sql('rx', 'ry')} AS c FROM (
    SELECT f.date, factor, horizon, {avg_rank_sql('f.date, factor, horizon', 'f.value')} AS rx, {avg_rank_sql('f.date, factor, horizon', 'y')} AS ry
    FROM signals f JOIN decay_y y ON f.date = y.date AND f.asset = y.asset WHERE f.value IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)


@query("signal_decay_profile", sql_with("decay", "SELECT factor, horizon, round(mean_rank_ic, 8) AS mean_rank_ic, n_obs FROM decay"))
def _(spark, d):
    return rounded(ev.signal_decay_profile(signals(spark, d), px(spark, d), max_group=assets_per_date(spark, d)))


FADING = (1, 2, 5)
cte(
    "halflife", "decay",
    """SELECT factor, CASE WHEN n >= 2 AND l > 0 THEN ln(cast(2 as double)) / l END AS half_life_periods FROM (
    SELECT factor, count(*) AS n, -regr_slope(ln(abs(mean_rank_ic)), cast(horizon as double)) AS l FROM decay WHERE mean_rank_ic <> 0 AND horizon <= 5 GROUP BY factor)""",
)


@query("signal_half_life", sql_with("halflife", "SELECT factor, round(half_life_periods, 6) AS half_life_periods FROM halflife"))
def _(spark, d):
    return rounded(ev.estimate_half_life(ev.signal_decay_profile(signals(spark, d), px(spark, d), horizons=FADING, max_group=assets_per_date(spark, d))), 6)


cte(
    "sig_cost", "sig_ls sig_lsto",
    "SELECT l.date, l.factor, long_short_return, long_short_turnover AS turnover, long_short_return - cast(0.001 as double) * long_short_turnover AS adjusted_return FROM sig_ls l JOIN sig_lsto t ON l.date = t.date AND l.factor = t.factor",
)


@query(
    "cost_adjusted_long_short",
    sql_with("sig_cost", "SELECT date, factor, round(long_short_return, 8) AS long_short_return, round(turnover, 8) AS turnover, round(adjusted_return, 8) AS adjusted_return FROM sig_cost"),
)
def _(spark, d):
    n = assets_per_date(spark, d)
    f, y = stored_signals(spark, d), fwd1(spark, d)
    ls = ev.long_short_return(ev.quantile_returns(f, y, max_group=n))
    to = ev.long_short_turnover(ev.quantile_turnover(ev.quantile_assignments(f, max_group=n)))
    return rounded(ev.cost_adjusted_long_short(ls, to, 0.001))


def summary_cte(name: str, prefix: str) -> None:
    cte(
        name, f"{prefix}_ic {prefix}_ls {prefix}_lsto",
        f"""SELECT i.factor, mean_ic, mean_rank_ic, ic_ir, mean_long_short_return, long_short_hit_rate, n_dates, mean_long_short_turnover FROM (
        SELECT factor, avg(ic) AS mean_ic, avg(rank_ic) AS mean_rank_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ic_ir, count(ic) AS n_dates FROM {prefix}_ic GROUP BY factor) i
        LEFT JOIN (SELECT factor, avg(long_short_return) AS mean_long_short_return, avg(cast(long_short_return > 0 as double)) AS long_short_hit_rate FROM {prefix}_ls GROUP BY factor) l ON i.factor = l.factor
        LEFT JOIN (SELECT t.factor, avg(long_short_turnover) AS mean_long_short_turnover FROM {prefix}_lsto t SEMI JOIN {prefix}_ls s ON t.factor = s.factor AND t.date = s.date GROUP BY t.factor) t ON i.factor = t.factor""",
    )


summary_cte("sig_summary", "sig")
SUMMARY_ROUND = """round(mean_ic, 7) AS mean_ic, round(mean_rank_ic, 7) AS mean_rank_ic, round(ic_ir, 7) AS ic_ir, round(mean_long_short_return, 7) AS mean_long_short_return,
 round(long_short_hit_rate, 7) AS long_short_hit_rate, n_dates, round(mean_long_short_turnover, 7) AS mean_long_short_turnover"""


@query("experiment_summary", sql_with("sig_summary", f"SELECT factor, {SUMMARY_ROUND} FROM sig_summary"))
def _(spark, d):
    n = assets_per_date(spark, d)
    f, y, _ = signals_and_label(spark, d)
    return rounded(ev.summary_of_pairs(f, ev.aligned(f, y), max_group=n), 7)


@query(
    "factor_report",
    sql_with(
        "sig_ics halflife",
        f"SELECT s.factor, metric, {_R}, round(half_life_periods, 6) AS half_life_periods FROM sig_ics s LEFT JOIN halflife h ON s.factor = h.factor",
    ),
)
def _(spark, d):
    f, _, prices = signals_and_label(spark, d)
    report = ev.build_factor_report(prices, f, horizon=1, decay_horizons=FADING, max_group=assets_per_date(spark, d))
    return rounded(report["ic_summary"].join(report["half_life"], "factor", "left"), 8, ic_ir=7, t_stat=6, half_life_periods=6)
