"""Diagnostics over execution tables derived from the rank-weighted portfolio."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from panelyard.catalog.panels import cte, fwd1, mkt_state, mom3, px, sql_with
from panelyard.catalog.portfolio import turnover_cte
from panelyard.catalog.registry import query
from panelyard.catalog.transforms import research_universe
from panelyard.functions.columns import rounded
from panelyard.functions.storage import materialize
from panelyard.operators import execution as ex
from panelyard.operators import portfolio as pf
from panelyard.operators.factors import momentum

# Target: top/bottom rank portfolio. Executed: its tradable part. Skipped: the rest, one row per exclusion reason.
cte("tgt", "w_rank", "SELECT date, asset, weight AS target_weight FROM w_rank")
cte("exe", "tgt uni", "SELECT t.date, t.asset, target_weight FROM tgt t JOIN uni u ON t.date = u.date AND t.asset = u.asset WHERE is_tradable")
_MAP = {k: v for k, v in ex.REASON_CODES.items()}
_CASE = "CASE trim(lower(r)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MAP.items()) + " ELSE trim(lower(r)) END"
cte(
    "skp_raw", "tgt uni reasons",
    """SELECT t.date, t.asset, ' ' || upper(r.reason) || ';' || CASE WHEN u.is_limit_locked THEN ' limit_locked_non_executable ;' ELSE 'custom_rule' END AS source_reason FROM tgt t
    JOIN uni u ON t.date = u.date AND t.asset = u.asset JOIN reasons r ON r.date = t.date AND r.asset = t.asset WHERE NOT u.is_tradable""",
)
cte(
    "skp", "skp_raw",
    f"""SELECT date, asset, source_reason, coalesce(nullif(array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(source_reason, ';'), lambda r: trim(r) <> ''), lambda r: {_CASE}))), ';'), ''), 'unclassified') AS reason_code FROM skp_raw""",
)


def target(spark, d, prices=None):
    return pf.portfolio_weights(mom3(spark, d) if prices is None else momentum(prices, window=3), "rank", top_k=15, bottom_k=10).withColumnRenamed("weight", "target_weight")


def executed(spark, d, of=None, prices=None, state=None):
    tradable = research_universe(spark, d, prices, state)["tradability"].where("is_tradable")
    return (target(spark, d) if of is None else of).join(tradable, ["date", "asset"], "left_semi")


def skipped(spark, d, of=None, prices=None, state=None):
    reasons = research_universe(spark, d, prices, state)["exclusion_reasons"].select("date", "asset", "reason")
    locked = (mkt_state(spark, d) if state is None else state).select("date", "asset", "is_limit_locked")
    rows = (target(spark, d) if of is None else of).join(reasons, ["date", "asset"]).join(locked, ["date", "asset"], "left")
    tail = F.when(F.coalesce("is_limit_locked", F.lit(False)), F.lit(" limit_locked_non_executable ;")).otherwise(F.lit("custom_rule"))
    rows = rows.select("date", "asset", F.concat(F.lit(" "), F.upper("reason"), F.lit(";"), tail).alias("source_reason"))
    return rows.withColumn("reason_code", ex.normalize_reason_code(F.col("source_reason")))


@query("reason_code_normalization", sql_with("skp", "SELECT date, asset, source_reason, reason_code FROM skp"))
def _(spark, d):
    return skipped(spark, d).select("date", "asset", "source_reason", "reason_code")


@query(
    "exclusion_reason_classes",
    sql_with("reasons", "SELECT CASE WHEN contains(lower(reason), 'limit') THEN 'price_limit' WHEN contains(lower(reason), 'suspend') OR contains(lower(reason), 'halt') THEN 'suspension' ELSE 'unknown' END AS class, count(*) AS n FROM reasons GROUP BY 1"),
)
def _(spark, d):
    rows = research_universe(spark, d)["exclusion_reasons"]
    return rows.groupBy(ex.classify_exclusion_reason(F.col("reason")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


cte(
    "delayed", "tgt",
    """SELECT date, asset, coalesce(lag(w, 2) OVER (PARTITION BY asset ORDER BY date), 0) AS executed_weight FROM (SELECT d.date, a.asset, coalesce(t.target_weight, 0) AS w FROM (SELECT DISTINCT date FROM tgt) d
    CROSS JOIN (SELECT DISTINCT asset FROM tgt) a LEFT JOIN tgt t ON t.date = d.date AND t.asset = a.asset)""",
)


@query("delayed_weights", sql_with("delayed", "SELECT date, asset, round(executed_weight, 10) AS executed_weight FROM delayed"))
def _(spark, d):
    return rounded(ex.delayed_weights(target(spark, d), delay=2), 10)


cte("tgt_w", "tgt", "SELECT date, asset, target_weight AS weight FROM tgt")
cte("exe_w", "exe", "SELECT date, asset, target_weight AS weight FROM exe")
turnover_cte("tgt_to", "tgt_w", "cast(0 as double)")
turnover_cte("exe_to", "exe_w", "cast(0 as double)")


@query("executed_turnover", sql_with("exe_to", "SELECT date, round(portfolio_turnover, 8) AS turnover FROM exe_to"))
def _(spark, d):
    return rounded(ex.weight_turnover(executed(spark, d)))


# Two runs as return and equity series: a tenth of the book follows the target or executed weights.
def series_cte(run: str, weights: str, turnover: str) -> None:
    cte(
        f"ser_{run}", f"{weights} {turnover} fwd1",
        f"""SELECT '{run}' AS run_id, date, r AS return, exp(sum(ln(1 + coalesce(r, 0))) OVER (ORDER BY date)) AS equity, turnover FROM (
        SELECT w.date, sum(w.target_weight * f.value) * cast(0.1 as double) AS r, any_value(t.portfolio_turnover) AS turnover FROM {weights} w JOIN fwd1 f ON f.date = w.date AND f.asset = w.asset JOIN {turnover} t ON t.date = w.date GROUP BY 1)""",
    )
    cte(
        f"perf_{run}", f"ser_{run}",
        f"""SELECT run_id, count(*) AS n_periods, avg(return) AS mean_return, stddev_samp(return) AS volatility, sqrt(cast(252 as double)) * avg(return) / nullif(stddev_samp(return), 0) AS sharpe_annualized,
        arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return, min(dd) AS max_drawdown, avg(turnover) AS mean_turnover FROM (SELECT *, equity / max(equity) OVER (ORDER BY date) - 1 AS dd FROM ser_{run}) GROUP BY run_id""",
    )


series_cte("target", "tgt", "tgt_to")
series_cte("executed", "exe", "exe_to")


def series(spark, d, weights, run):
    daily = weights.join(fwd1(spark, d), ["date", "asset"]).groupBy("date").agg((F.sum(F.col("target_weight") * F.col("value")) * F.lit(0.1)).alias("return"))
    # One row per date of a run. A loss of all leaves 0, a loss of more than all no equity: NaN from there on.
    kept = 1 + F.coalesce("return", F.lit(0.0))
    log = F.when(kept > 0, F.ln(kept)).when(kept == 0, float("-inf")).otherwise(float("nan"))
    growth = F.exp(F.sum(log).over(W.partitionBy("run_id").orderBy("date")))
    return daily.join(ex.weight_turnover(weights), "date").withColumn("run_id", F.lit(run)).withColumn("equity", growth)


_PERF = "n_periods, round(mean_return, 8) AS mean_return, round(volatility, 8) AS volatility, round(sharpe_annualized, 6) AS sharpe_annualized, round(total_return, 5) AS total_return, round(max_drawdown, 7) AS max_drawdown, round(mean_turnover, 8) AS mean_turnover"


@query("performance_summary", sql_with("perf_target perf_executed", f"SELECT run_id, {_PERF} FROM perf_target UNION ALL SELECT run_id, {_PERF} FROM perf_executed"))
def _(spark, d):
    both = series(spark, d, target(spark, d), "target").unionByName(series(spark, d, executed(spark, d), "executed"))
    return rounded(ex.performance_summary(both), 8, sharpe_annualized=6, total_return=5, max_drawdown=7)


cte(
    "dist", "skp",
    """SELECT reason_code, n AS skipped_order_count, n / cast(sum(n) OVER () as double) AS skipped_order_ratio, row_number() OVER (ORDER BY n DESC, reason_code) = 1 AS is_dominant, ex AS source_reason_examples FROM (
    SELECT reason_code, count(*) AS n, array_to_string(list_slice(list_sort(list_distinct(list(trim(source_reason)))), 1, 5), ';') AS ex FROM skp GROUP BY 1)""",
)


@query("skipped_reason_distribution", sql_with("dist", "SELECT reason_code, skipped_order_count, round(skipped_order_ratio, 10) AS skipped_order_ratio, is_dominant, source_reason_examples FROM dist"))
def _(spark, d):
    return rounded(ex.reason_distribution(skipped(spark, d)), 10)


cte("dev", "tgt exe", "SELECT coalesce(t.date, e.date) AS date, coalesce(t.target_weight, 0) AS t, coalesce(e.target_weight, 0) AS e FROM tgt t FULL JOIN exe e ON t.date = e.date AND t.asset = e.asset")
cte("dev_date", "dev", "SELECT date, sum(abs(t)) AS tg, sum(abs(e)) AS rg, abs(sum(abs(t)) - sum(abs(e))) AS gd, avg(abs(t - e)) AS ma, max(abs(t - e)) AS mx FROM dev GROUP BY 1")


@query(
    "execution_deviation_by_date",
    sql_with("dev_date", "SELECT date, round(tg, 8) AS target_gross, round(rg, 8) AS realized_gross, round(gd, 8) AS gross_abs_diff, round(ma, 8) AS mean_abs_weight_diff, round(mx, 8) AS max_abs_weight_diff FROM dev_date"),
)
def _(spark, d):
    return rounded(ex.execution_deviation(target(spark, d), executed(spark, d))["by_date"])


cte("dev_sum", "dev dev_date", "SELECT (SELECT avg(abs(t - e)) FROM dev) AS ma, (SELECT max(abs(t - e)) FROM dev) AS mx, avg(tg) AS tg, avg(rg) AS rg, avg(gd) AS gd, max(gd) AS gx FROM dev_date")


@query(
    "execution_deviation_summary",
    sql_with("dev_sum", "SELECT round(ma, 8) AS mean_abs_weight_diff, round(mx, 8) AS max_abs_weight_diff, round(tg, 8) AS target_gross_mean, round(rg, 8) AS realized_gross_mean, round(gd, 8) AS gross_abs_diff_mean, round(gx, 8) AS gross_abs_diff_max FROM dev_sum"),
)
def _(spark, d):
    return rounded(ex.execution_deviation(target(spark, d), executed(spark, d))["summary"])


cte(
    "effect", "tgt_to exe_to exe skp",
    """SELECT *, t - r AS cut, (t - r) / t AS share, s / cast(o + s as double) AS skipped FROM (SELECT (SELECT avg(portfolio_turnover) FROM tgt_to) AS t, (SELECT avg(portfolio_turnover) FROM exe_to) AS r,
    (SELECT count(*) FROM exe) AS o, (SELECT count(*) FROM skp) AS s)""",
)


@query(
    "turnover_effect",
    sql_with(
        "effect",
        """SELECT round(t, 8) AS target_mean_turnover, round(r, 8) AS realized_mean_turnover, o AS n_orders, s AS n_skipped_orders, round(cut, 8) AS turnover_reduction, round(share, 8) AS turnover_reduction_ratio,
        round(skipped, 8) AS skipped_order_ratio, share >= 0.1 AS material_turnover_reduction FROM effect""",
    ),
)
def _(spark, d):
    e = executed(spark, d)
    return rounded(ex.turnover_effect(target(spark, d), e, e, skipped(spark, d)))


@query(
    "execution_impact_flags",
    sql_with(
        "dist dev_sum effect",
        """SELECT 'dominant_execution_blocker' AS flag, cast(null as double) AS observed, reason_code AS observed_text, cast(null as double) AS threshold, true AS triggered FROM dist WHERE is_dominant
        UNION ALL SELECT 'high_execution_deviation', round(ma, 8), NULL, 0.02, ma >= 0.02 FROM dev_sum UNION ALL SELECT 'severe_tradability_constraints', round(skipped, 8), NULL, 0.2, skipped >= 0.2 FROM effect
        UNION ALL SELECT f, round(o, 8), NULL, l, o >= l FROM (SELECT f, l, coalesce((SELECT max(skipped_order_ratio) FROM dist WHERE reason_code = c), 0) AS o FROM (VALUES ('price_limit_sensitive', 'price_limit_locked', cast(0.05 as double)),
        ('liquidity_sensitive', 'min_adv_filter', cast(0.1 as double)), ('reentry_constraint_sensitive', 'same_day_reentry_blocked', cast(0.02 as double))) v(f, c, l))""",
    ),
)
def _(spark, d):
    # Target, execution and skipped orders read the same prices and states, which are taken from the lines once.
    prices, state = materialize(px(spark, d)), materialize(mkt_state(spark, d))
    # The report reads each of them several times; they have some rows per date.
    t = materialize(target(spark, d, prices))
    e, s = materialize(executed(spark, d, t, prices, state)), materialize(skipped(spark, d, t, prices, state))
    return rounded(ex.build_execution_impact_report(t, e, e, s)["flags"])


_CMP = [("total_return", 5), ("sharpe_annualized", 6), ("max_drawdown", 6), ("mean_turnover", 6)]


@query(
    "run_comparison",
    sql_with(
        "perf_target perf_executed dev_sum",
        " UNION ALL ".join(f"SELECT '{m}' AS metric, round(p.{m}, 5) AS primary_value, round(c.{m}, 5) AS comparison FROM perf_target p, perf_executed c" for m, _ in _CMP)
        + """ UNION ALL SELECT 'mean_abs_weight_diff', round(ma, 5), 0 FROM dev_sum UNION ALL SELECT 'max_abs_weight_diff', round(mx, 5), 0 FROM dev_sum UNION ALL SELECT 'target_weights_equal', 0, 0""",
    ),
)
def _(spark, d):
    t, e = target(spark, d), executed(spark, d)
    perf = {n: ex.performance_summary(series(spark, d, w, n)) for n, w in (("target", t), ("executed", e))}
    out = ex.compare_runs((t, e, perf["target"]), (e, e, perf["executed"]))
    return rounded(out.withColumnRenamed("primary", "primary_value"), 5)
