"""Experiments, walk-forward validation, registries, verdicts and whole workflows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelyard.catalog.evaluation import SUMMARY_ROUND, bucket_cte, metric_ctes, pair_ctes, summary_cte, turnover_ctes
from panelyard.catalog.frictions import OPTS, cost_ctes, exposure_ctes
from panelyard.catalog.panels import (
    asset_meta, assets_per_date, cte, fundamentals, fwd1, mkt_state, mom3, px, px_and_state, signals, signals_and_label, signals_of, sql_with, stored_signals,
)
from panelyard.catalog.portfolio import SPEC, legs_cte, plan_cte, rank_weights_cte, returns_cte, turnover_cte, valid_cte
from panelyard.catalog.registry import query
from panelyard.catalog.screening import BREADTH, alpha_ctes, alpha_panel, compose_ctes, corr_ctes, ic_t_cte, inflation_ctes, mono_ctes, tail_ctes, weight_ctes
from panelyard.catalog.transforms import PREP, RULES
from panelyard.catalog.validation import WF, purge_ctes
from panelyard.functions.columns import rounded
from panelyard.functions.storage import materialize, scratch_dir
from panelyard.operators import composite as cp
from panelyard.operators import evaluation as ev
from panelyard.operators import registry as reg
from panelyard.operators import verdicts as vd
from panelyard.operators.factors import momentum, reversal
from panelyard.plans import experiment as xp
from panelyard.plans import walk_forward as wfp
from panelyard.plans import workflows as wk
from panelyard.sources.research_inputs import neutralization_exposures


# A test-period experiment with a portfolio.
cte("oos", "mom3", "SELECT * FROM mom3 WHERE date >= date '1998-07-01'")
pair_ctes("oos", "oos", "fwd1")
bucket_cte("oos_asgn", "oos", "value", "WHERE value IS NOT NULL")
turnover_ctes("oos", "oos_asgn")
summary_cte("oos_summary", "oos")


def oos_experiment(spark, d, **options):
    return xp.run_factor_experiment(
        materialize(px(spark, d)), lambda p: momentum(p, window=3), train_end="1998-06-30", test_start="1998-07-01", max_group=assets_per_date(spark, d), **options
    )


@query("split_sample_experiment", sql_with("oos_summary", f"SELECT factor, {SUMMARY_ROUND} FROM oos_summary"))
def _(spark, d):
    return rounded(oos_experiment(spark, d)["summary"], 7)


cte("oos_adj", "oos_ls oos_lsto", "SELECT avg(long_short_return - cast(0.001 as double) * long_short_turnover) AS adj FROM oos_ls l JOIN oos_lsto t ON l.date = t.date AND l.factor = t.factor")


@query(
    "experiment_summary_row",
    sql_with(
        "oos_summary oos_adj",
        """SELECT factor AS factor_name, 'forward_return_1' AS label_name, cast(5 as integer) AS n_quantiles, 'test from 1998-07-01' AS split_description, round(mean_ic, 7) AS mean_ic, round(mean_rank_ic, 7) AS mean_rank_ic,
        round(ic_ir, 7) AS ic_ir, round(mean_long_short_return, 7) AS mean_long_short_return, round(long_short_hit_rate, 7) AS long_short_hit_rate, n_dates AS n_dates_used,
        round(mean_long_short_turnover, 7) AS mean_long_short_turnover, cast(0.001 as double) AS cost_rate, round(adj, 7) AS mean_cost_adjusted_long_short_return FROM oos_summary, oos_adj""",
    ),
)
def _(spark, d):
    out = xp.summary_row(oos_experiment(spark, d), label_name="forward_return_1", n_quantiles=5, split_description="test from 1998-07-01", cost_rate=0.001)
    return rounded(out, 7)


valid_cte("oos_valid", "oos")
legs_cte("oos_legs", 15, 10, "oos_valid")
rank_weights_cte("oos_w", "oos_legs")
cte("oos_y", "fwd1", "SELECT * FROM fwd1 WHERE date >= date '1998-07-01'")
returns_cte("oos_ret", "oos_w", "oos_y", 3, 2)


@query("experiment_portfolio_returns", sql_with("oos_ret", "SELECT 'momentum_3d' AS factor, date, round(portfolio_return, 8) AS portfolio_return FROM oos_ret"))
def _(spark, d):
    return rounded(oos_experiment(spark, d, strategy=SPEC)["portfolio_returns"])


# Walk-forward: the fold id plays the part of the factor in the shared CTE builders.
cte(
    "wfx_f", "mom3 wf wfw",
    "SELECT cast(f.fold_id as varchar) AS factor, f.fold_id, m.date, m.asset, m.value, w.test_end FROM mom3 m JOIN wf f ON f.date = m.date AND f.role = 'test' JOIN wfw w ON w.fold_id = f.fold_id",
)
cte("reg1", "px", "SELECT date, asset, lead(close) OVER w / close - 1 AS y, lead(date) OVER w AS event_end FROM px WINDOW w AS (PARTITION BY asset ORDER BY date)")
cte("wfx_pairs", "wfx_f reg1", "SELECT f.date, f.asset, f.factor, 'forward_return_1' AS label, f.value AS x, CASE WHEN event_end <= test_end THEN y END AS y FROM wfx_f f JOIN reg1 r ON f.date = r.date AND f.asset = r.asset")
metric_ctes("wfx")
bucket_cte("wfx_asgn", "wfx_f", "value", "WHERE value IS NOT NULL")
turnover_ctes("wfx", "wfx_asgn")
summary_cte("wfx_summary", "wfx")
cte("wfx_adj", "wfx_ls wfx_lsto", "SELECT l.factor, avg(long_short_return - cast(0.001 as double) * long_short_turnover) AS adj FROM wfx_ls l JOIN wfx_lsto t ON l.date = t.date AND l.factor = t.factor GROUP BY 1")
cte("wf_w", "w_rank wf", "SELECT f.fold_id, w.* FROM w_rank w JOIN wf f ON f.date = w.date AND f.role = 'test'")
cte("wf_r", "wfx_f reg1", "SELECT DISTINCT f.fold_id, r.date, r.asset, CASE WHEN r.event_end <= w.test_end THEN y END AS value FROM reg1 r JOIN wf f ON f.date = r.date AND f.role = 'test' JOIN wfw w ON w.fold_id = f.fold_id")
returns_cte("wf_ret", "wf_w", "wf_r", 3, 2, "fold_id")
cte("wf_wa", "wf_w", "SELECT w.* FROM wf_w w SEMI JOIN (SELECT fold_id, date FROM (SELECT fold_id, date, row_number() OVER (PARTITION BY fold_id ORDER BY date) - 1 AS n FROM (SELECT DISTINCT fold_id, date FROM wf_w)) WHERE n % 2 = 0) a ON a.fold_id = w.fold_id AND a.date = w.date")
turnover_cte("wf_to", "wf_wa", key="fold_id")
cte(
    "wf_cost", "wf_ret wf_to",
    "SELECT r.fold_id, r.date, portfolio_return - cast(0.002 as double) * CASE WHEN t.date IS NULL THEN 0 ELSE portfolio_turnover END AS adjusted_return FROM wf_ret r LEFT JOIN wf_to t ON r.fold_id = t.fold_id AND r.date = t.date",
)
cte(
    "wf_sum", "wfw wfx_summary wfx_adj wf_ret wf_to wf_cost",
    """SELECT w.fold_id, w.train_start, w.train_end, w.test_start AS start_date, w.test_end AS end_date, mean_ic, mean_rank_ic, ic_ir, mean_long_short_return AS mean_long_short, mean_long_short_turnover AS mean_turnover,
    adj AS mean_cost_adjusted_return, mean_portfolio_return, portfolio_hit_rate, mean_portfolio_turnover, mean_cost_adjusted_portfolio_return FROM wfw w
    LEFT JOIN wfx_summary s ON s.factor = cast(w.fold_id as varchar) LEFT JOIN wfx_adj a ON a.factor = s.factor
    LEFT JOIN (SELECT fold_id, avg(portfolio_return) AS mean_portfolio_return, avg(cast(portfolio_return > 0 as double)) AS portfolio_hit_rate FROM wf_ret GROUP BY 1) p ON p.fold_id = w.fold_id
    LEFT JOIN (SELECT fold_id, avg(portfolio_turnover) AS mean_portfolio_turnover FROM wf_to GROUP BY 1) t ON t.fold_id = w.fold_id
    LEFT JOIN (SELECT fold_id, avg(adjusted_return) AS mean_cost_adjusted_portfolio_return FROM wf_cost GROUP BY 1) c ON c.fold_id = w.fold_id""",
)


def walk_forward(spark, d):
    return wfp.run_walk_forward_experiment(
        materialize(px(spark, d)), lambda p: momentum(p, window=3), cost_rate=0.001, strategy=SPEC, portfolio_cost_rate=0.002, max_group=assets_per_date(spark, d), **WF
    )


_FOLD_METRICS = (
    "mean_ic", "mean_rank_ic", "ic_ir", "mean_long_short", "mean_turnover", "mean_cost_adjusted_return", "mean_portfolio_return", "portfolio_hit_rate",
    "mean_portfolio_turnover", "mean_cost_adjusted_portfolio_return",
)


@query(
    "walk_forward_fold_summary",
    sql_with("wf_sum", "SELECT fold_id, train_start, train_end, start_date, end_date, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FOLD_METRICS) + " FROM wf_sum"),
)
def _(spark, d):
    return rounded(walk_forward(spark, d)["fold_summary"], 6)


@query("walk_forward_pooled_ic", sql_with("wfx_ic", "SELECT cast(factor as integer) AS fold_id, date, round(ic, 8) AS ic FROM wfx_ic"))
def _(spark, d):
    return rounded(walk_forward(spark, d)["pooled_ic"])


@query(
    "walk_forward_aggregate",
    sql_with(
        "wf_sum wfx_ic wf_ret",
        """SELECT count(*) AS n_folds, round(avg(mean_ic), 6) AS mean_ic, round(stddev_samp(mean_ic), 6) AS std_ic, round(avg(mean_turnover), 6) AS mean_turnover, arg_max(fold_id, mean_ic) AS best_fold, arg_min(fold_id, mean_ic) AS worst_fold,
        (SELECT round(avg(ic), 6) FROM wfx_ic) AS pooled_ic_mean, (SELECT round(avg(ic) / stddev_samp(ic), 6) FROM wfx_ic) AS pooled_ic_ir, (SELECT count(ic) FROM wfx_ic) AS n_ic_obs,
        (SELECT round(avg(portfolio_return), 6) FROM wf_ret) AS pooled_portfolio_return_mean, (SELECT count(portfolio_return) FROM wf_ret) AS n_pooled_portfolio_return_obs FROM wf_sum""",
    ),
)
def _(spark, d):
    out = walk_forward(spark, d)["aggregate"]
    return rounded(out.select(
        "n_folds", "mean_ic", "std_ic", "mean_turnover", "best_fold", "worst_fold", "pooled_ic_mean", "pooled_ic_ir", "n_ic_obs", "pooled_portfolio_return_mean",
        "n_pooled_portfolio_return_obs",
    ), 6)


# Registries: entries are the factors of the signal table.
def _summary(spark, d):
    n = assets_per_date(spark, d)
    f, y, _ = signals_and_label(spark, d)
    return ev.summary_of_pairs(f, ev.aligned(f, y), max_group=n)


@query("trial_log_append", sql_with("sig_summary", "SELECT factor AS factor_name, round(mean_rank_ic, 7) AS mean_rank_ic, cast(2 as bigint) AS n_rows FROM sig_summary"))
def _(spark, d):
    path = f"{scratch_dir(spark)}/files/{uuid.uuid4().hex}"
    rows = materialize(reg.trial_rows(_summary(spark, d).withColumnRenamed("factor", "factor_name"), experiment_name="first", trial_count=3))
    reg.append_trial_log(rows, path)
    reg.append_trial_log(rows.withColumn("experiment_name", F.lit("second")), path)
    log = reg.load_trial_log(spark, path)
    return rounded(log.groupBy("factor_name").agg(F.max("mean_rank_ic").alias("mean_rank_ic"), F.count(F.lit(1)).alias("n_rows")), 7)


cte("alphas", "sig_summary", "SELECT factor AS alpha_id, mean_rank_ic AS ic_mean, ic_ir, 'candidate' AS lifecycle_stage FROM sig_summary")
cte(
    "upserted", "alphas",
    """SELECT alpha_id, ic_mean, ic_ir, 'discovery' AS lifecycle_stage FROM alphas WHERE alpha_id LIKE 'rev%' UNION ALL SELECT 'extra_' || alpha_id, ic_mean, ic_ir, 'discovery' FROM alphas WHERE alpha_id LIKE 'rev%'
    UNION ALL SELECT * FROM alphas WHERE alpha_id NOT LIKE 'rev%'""",
)


def upserted(spark, d):
    path = f"{scratch_dir(spark)}/files/{uuid.uuid4().hex}"
    none = F.lit(None).cast("double").alias("half_life_periods")
    entries = materialize(reg.alpha_entries(_summary(spark, d), spark.range(0).select(F.lit("").alias("factor"), none)))
    reg.upsert_alpha_registry(entries, path)
    changed = entries.where("alpha_id like 'rev%'").withColumn("lifecycle_stage", F.lit("discovery"))
    extra = changed.withColumn("alpha_id", F.concat(F.lit("extra_"), "alpha_id"))
    return reg.upsert_alpha_registry(changed.unionByName(extra), path)


@query("alpha_registry_upsert", sql_with("upserted", "SELECT alpha_id, round(ic_mean, 7) AS ic_mean, round(ic_ir, 7) AS ic_ir, lifecycle_stage FROM upserted"))
def _(spark, d):
    return rounded(upserted(spark, d).select("alpha_id", "ic_mean", "ic_ir", "lifecycle_stage"), 7)


@query("alpha_registry_stage_summary", sql_with("upserted", "SELECT lifecycle_stage, count(DISTINCT alpha_id) AS n_alphas, round(avg(ic_mean), 7) AS mean_ic_mean, round(avg(ic_ir), 7) AS mean_ic_ir FROM upserted GROUP BY 1"))
def _(spark, d):
    return rounded(reg.alpha_registry_stage_summary(upserted(spark, d)), 7)


@query(
    "ranked_experiments",
    sql_with(
        "sig_summary oos_summary",
        """SELECT rank, factor, round(ic_ir, 7) AS ic_ir, n_dates FROM (SELECT *, row_number() OVER (ORDER BY ic_ir DESC NULLS LAST, factor, n_dates) AS rank FROM (
        SELECT factor, ic_ir, n_dates FROM sig_summary UNION ALL SELECT factor, ic_ir, n_dates FROM oos_summary UNION ALL SELECT factor || '_x', NULL, n_dates FROM sig_summary))""",
    ),
)
def _(spark, d):
    a = materialize(_summary(spark, d).select("factor", "ic_ir", "n_dates"))
    b = oos_experiment(spark, d)["summary"].select("factor", "ic_ir", "n_dates")
    c = a.select(F.concat("factor", F.lit("_x")).alias("factor"), F.lit(None).cast("double").alias("ic_ir"), "n_dates")
    out = reg.rank_experiments(reg.compare_experiments([a, b, c]), "ic_ir")
    return rounded(out.select(F.col("rank").cast("long").alias("rank"), "factor", "ic_ir", "n_dates"), 7)


# Verdicts: one candidate per supplier, metrics from its own statistics.
cte(
    "cand", "fwd1",
    """SELECT asset AS case_id, avg(value) / 20 AS mean_rank_ic, avg(value) / nullif(stddev_samp(value), 0) AS ic_ir, count(value) / cast(count(*) as double) AS mean_coverage,
    cast(cast(asset as integer) % 10 as double) / 10 + 0.3::double AS mean_tradable_ratio, CASE WHEN cast(asset as integer) % 4 = 0 THEN 'weak_factor' ELSE 'candidate_factor' END AS screening_decision,
    CASE WHEN cast(asset as integer) % 3 = 0 THEN cast(0.2 as double) WHEN cast(asset as integer) % 3 = 1 THEN cast(0.01 as double) END AS adjusted_pvalue,
    CASE WHEN cast(asset as integer) % 11 = 0 THEN 0 ELSE count(*) END AS min_fold_train, count(*) AS min_fold_test FROM fwd1 GROUP BY asset""",
)


def candidates(spark, d):
    n = F.col("asset").cast("int")
    v = F.col("value")
    base = fwd1(spark, d).groupBy("asset").agg(
        (F.avg(v) / 20).alias("mean_rank_ic"), F.try_divide(F.avg(v), F.stddev_samp(v)).alias("ic_ir"), (F.count(v) / F.count(F.lit(1))).alias("mean_coverage"),
        F.count(F.lit(1)).alias("rows"),
    )
    return base.select(
        F.col("asset").alias("case_id"), "mean_rank_ic", "ic_ir", "mean_coverage", ((n % 10).cast("double") / 10 + F.lit(0.3)).alias("mean_tradable_ratio"),
        F.when(n % 4 == 0, "weak_factor").otherwise("candidate_factor").alias("screening_decision"),
        F.when(n % 3 == 0, F.lit(0.2)).when(n % 3 == 1, F.lit(0.01)).alias("adjusted_pvalue"),
        F.when(n % 11 == 0, F.lit(0).cast("long")).otherwise(F.col("rows")).alias("min_fold_train"), F.col("rows").alias("min_fold_test"),
    )


def verdict_sql(source: str, blockers: list[tuple[str, str]], warnings: list[tuple[str, str]], external: str, keep: str) -> str:
    def listed(items):
        cases = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in sorted(items))
        return f"coalesce(array_to_string(list_filter([{cases}], lambda c: c IS NOT NULL), '|'), '')"

    return f"""SELECT {keep}, blocking_issues, warnings, CASE WHEN blocking_issues <> '' THEN 'reject' WHEN external AND warnings = '' THEN 'candidate_for_external_backtest' WHEN warnings <> '' THEN 'needs_review'
    ELSE 'candidate_for_registry' END AS verdict FROM (SELECT *, {listed(blockers)} AS blocking_issues, {listed(warnings)} AS warnings, coalesce({external}, false) AS external FROM {source})"""


SINGLE_BLOCKERS = [
    ("mean_rank_ic_below_registry_threshold", "mean_rank_ic IS NULL OR mean_rank_ic < 0.01"), ("ic_ir_below_registry_threshold", "ic_ir IS NULL OR ic_ir < 0.1"),
    ("coverage_below_threshold", "mean_coverage IS NULL OR mean_coverage < 0.6"), ("tradable_ratio_below_threshold", "mean_tradable_ratio IS NULL OR mean_tradable_ratio < 0.5"),
    ("factor_screening_not_candidate", "screening_decision IS DISTINCT FROM 'candidate_factor'"), ("validation_fold_without_train_samples", "min_fold_train <= 0"),
    ("validation_fold_without_test_samples", "min_fold_test <= 0"),
]
SINGLE_WARNINGS = [("multiple_testing_adjusted_pvalue_above_external_threshold", "adjusted_pvalue > 0.1")]
SINGLE_EXTERNAL = "mean_rank_ic >= 0.02 AND ic_ir >= 0.2 AND (adjusted_pvalue IS NULL OR adjusted_pvalue <= 0.1)"
cte("sverdict", "cand", verdict_sql("cand", SINGLE_BLOCKERS, SINGLE_WARNINGS, SINGLE_EXTERNAL, "case_id"))


@query("single_factor_verdicts", sql_with("sverdict", "SELECT * FROM sverdict"))
def _(spark, d):
    return vd.single_factor_verdict(candidates(spark, d)).select("case_id", "blocking_issues", "warnings", "verdict")


COMP_BLOCKERS = [
    ("insufficient_selected_factors", "n_selected_factors < 2"), ("composite_rank_ic_below_registry_threshold", "mean_rank_ic IS NULL OR mean_rank_ic < 0.01"),
    ("composite_ic_ir_below_registry_threshold", "ic_ir IS NULL OR ic_ir < 0.1"), ("effective_breadth_below_registry_threshold", "effective_breadth IS NULL OR effective_breadth < 1.2"),
]
COMP_WARNINGS = [("capacity_diagnostics_missing", "NOT has_capacity"), ("cost_diagnostics_missing", "NOT has_cost"), ("exposure_diagnostics_missing", "NOT has_exposure")]
COMP_EXTERNAL = """mean_rank_ic >= 0.02 AND ic_ir >= 0.2 AND effective_breadth >= 1.6 AND avg_abs_corr <= 0.7 AND (adv_flag_ratio IS NULL OR adv_flag_ratio <= 0.15) AND (mean_cost_bps IS NULL OR mean_cost_bps <= 25)
 AND (max_abs_industry_exposure IS NULL OR max_abs_industry_exposure <= 0.25) AND (max_abs_style_exposure IS NULL OR max_abs_style_exposure <= 0.3)"""
cte(
    "ccand", "cand",
    """SELECT case_id, mean_rank_ic, ic_ir, cast(case_id as integer) % 4 AS n_selected_factors, 1 + cast(cast(case_id as integer) % 5 as double) / 4 AS effective_breadth, cast(0.4 as double) AS avg_abs_corr,
    CASE WHEN cast(case_id as integer) % 2 = 0 THEN cast(0.1 as double) END AS adv_flag_ratio, cast(cast(case_id as integer) as double) AS mean_cost_bps, cast(0.2 as double) AS max_abs_industry_exposure,
    cast(null as double) AS max_abs_style_exposure, true AS has_capacity, cast(case_id as integer) % 7 <> 0 AS has_cost, true AS has_exposure FROM cand""",
)


@query("composite_verdicts", sql_with("ccand", verdict_sql("ccand", COMP_BLOCKERS, COMP_WARNINGS, COMP_EXTERNAL, "case_id")))
def _(spark, d):
    n = F.col("case_id").cast("int")
    table = candidates(spark, d).select(
        "case_id", "mean_rank_ic", "ic_ir", (n % 4).alias("n_selected_factors"), (1 + (n % 5).cast("double") / 4).alias("effective_breadth"), F.lit(0.4).alias("avg_abs_corr"),
        F.when(n % 2 == 0, F.lit(0.1)).alias("adv_flag_ratio"), n.cast("double").alias("mean_cost_bps"), F.lit(0.2).alias("max_abs_industry_exposure"),
        F.lit(None).cast("double").alias("max_abs_style_exposure"), F.lit(True).alias("has_capacity"), (n % 7 != 0).alias("has_cost"), F.lit(True).alias("has_exposure"),
    )
    return vd.composite_verdict(table).select("case_id", "blocking_issues", "warnings", "verdict")


cte("cad_in", "px_gap", "SELECT asset, CASE WHEN cast(asset as integer) % 9 = 0 THEN NULL ELSE cast(count(*) % 120 as double) + 0.5::double END AS half_life_periods, cast(count(*) % 6 as double) AS turnover FROM px_gap GROUP BY asset")


@query(
    "rebalance_cadence",
    sql_with(
        "cad_in",
        """SELECT asset, n AS cadence_periods, CASE WHEN n <= 2 THEN 'daily_or_2day' WHEN n <= 7 THEN 'weekly' WHEN n <= 15 THEN 'biweekly' WHEN n <= 31 THEN 'monthly' ELSE 'slow_monthly_plus' END AS cadence_label,
        coalesce(array_to_string(list_filter([CASE WHEN turnover > 4 AND n <= 3 THEN 'high_turnover_and_fast_cadence_execution_risk' END, CASE WHEN half_life_periods > 40 THEN 'signal_half_life_is_slow_moving' END,
        CASE WHEN half_life_periods < 3 THEN 'signal_half_life_is_very_short' END, CASE WHEN turnover > 2 AND n <= 5 THEN 'turnover_is_high_consider_trade_buffer' END], lambda c: c IS NOT NULL), '|'), '') AS warnings FROM (
        SELECT *, CASE WHEN half_life_periods IS NULL THEN 5 ELSE cast(round_even(greatest(1, least(63, half_life_periods / 2)), 0) as integer) END AS n FROM cad_in)""",
    ),
)
def _(spark, d):
    from panelyard.catalog.panels import px_gap

    n = F.count(F.lit(1))
    table = px_gap(spark, d).groupBy("asset").agg(
        F.when(F.col("asset").cast("int") % 9 != 0, (n % 120).cast("double") + F.lit(0.5)).alias("half_life_periods"), (n % 6).cast("double").alias("turnover")
    )
    return vd.recommend_rebalance_cadence(table, turnover_col="turnover").select("asset", "cadence_periods", "cadence_label", "warnings")


@query(
    "campaign_summary",
    sql_with(
        "sverdict",
        """SELECT 'verdict' AS section, verdict AS name, count(*) AS n FROM sverdict GROUP BY 2
        UNION ALL SELECT 'execution_blocker', 'blocker_' || (cast(case_id as integer) % 3), count(*) FROM sverdict WHERE cast(case_id as integer) % 3 > 0 GROUP BY 2
        UNION ALL SELECT 'top_candidate', case_id, 1 FROM sverdict WHERE verdict IN ('candidate_for_registry', 'candidate_for_external_backtest') AND cast(case_id as integer) % 5 > 0""",
    ),
)
def _(spark, d):
    n = F.col("case_id").cast("int")
    packages = vd.single_factor_verdict(candidates(spark, d)).select(
        "case_id", "verdict", F.when(n % 5 == 0, "blocked").otherwise("ready").alias("readiness"),
        F.when(n % 3 > 0, F.concat(F.lit("blocker_"), (n % 3).cast("string"))).alias("dominant_blocker"),
    )
    return vd.campaign_summary(packages)


# Whole workflows.
def inputs(spark, d):
    return dict(asset_metadata=asset_meta(spark, d), market_state=mkt_state(spark, d), max_group=assets_per_date(spark, d))



cte("mask1", "rev2 uni", "SELECT s.date, s.asset, s.factor, CASE WHEN coalesce(in_universe, false) AND coalesce(is_tradable, false) THEN value END AS value FROM rev2 s LEFT JOIN uni u ON s.date = u.date AND s.asset = u.asset")
cte(
    "prep1", "mask1",
    """SELECT date, asset, factor, CASE WHEN count(value) OVER w >= 5 THEN CASE WHEN min(value) OVER w = max(value) OVER w THEN cast(0 as double) ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END END AS value FROM (
     SELECT date, asset, factor, CASE WHEN count(value) OVER w < 5 THEN value WHEN value IS NOT NULL THEN greatest(least(value, quantile_cont(value, 0.98) OVER w), quantile_cont(value, 0.02) OVER w) END AS value FROM mask1 WINDOW w AS (PARTITION BY date))
     WINDOW w AS (PARTITION BY date)""",
)
cte("prep_gate1", "prep1", "SELECT * FROM prep1 QUALIFY count(value) OVER (PARTITION BY date) / cast(count(*) OVER (PARTITION BY date) as double) >= 0.2")
cte("q9", "prep_gate1", "SELECT * FROM prep_gate1")
pair_ctes("q9", "q9", "fwd1")
mono_ctes("q9", "q9")
ic_t_cte("q9_t", "q9_ic")
tail_ctes("q9_t", "q9_t")
cte(
    "q9_iv", "px",
    "SELECT row_number() OVER () AS sample_id, date AS decision_date, date AS event_start, greatest(coalesce(lead(date) OVER (PARTITION BY asset ORDER BY date), date + 1), date) AS event_end FROM px",
)
purge_ctes("q9_folds", [(g,) for g in range(5)], 5, 1, "q9_iv")
cte("q9_least", "q9_folds", "SELECT min(a) AS n_train, min(b) AS n_test FROM (SELECT count(*) FILTER (role = 'train') AS a, count(*) FILTER (role = 'test') AS b FROM q9_folds GROUP BY fold_id)")
cte(
    "q9_m", "q9_uni q9_ic q9 fwd1 uni q9_t_p q9_least",
    """SELECT u.factor, i.r AS mean_rank_ic, i.ir AS ic_ir, cov AS mean_coverage, trd AS mean_tradable_ratio, CASE WHEN rank_ic_mean IS NULL OR abs_monotonicity IS NULL THEN 'needs_review' WHEN u.coverage < 0.3 OR abs_monotonicity < 0.1 THEN 'weak_factor' ELSE 'candidate_factor' END AS screening_decision,
    (SELECT max(least(p, 1)) FROM q9_t_p) AS adjusted_pvalue, (SELECT n_train FROM q9_least) AS min_fold_train, (SELECT n_test FROM q9_least) AS min_fold_test FROM q9_uni u, (SELECT avg(rank_ic) AS r, avg(ic) / stddev_samp(ic) AS ir FROM q9_ic) i,
    (SELECT avg(nb / nullif(cast(nf as double), 0)) AS cov FROM (SELECT coalesce(f.date, y.date) AS date, count(f.asset) AS nf, count(*) FILTER (f.asset IS NOT NULL AND y.asset IS NOT NULL) AS nb
      FROM (SELECT * FROM q9 WHERE value IS NOT NULL) f FULL JOIN (SELECT * FROM fwd1 WHERE value IS NOT NULL) y ON f.date = y.date AND f.asset = y.asset GROUP BY 1)) c,
    (SELECT avg(tr) AS trd FROM (SELECT count(*) FILTER (is_tradable) / cast(count(DISTINCT asset) as double) AS tr FROM uni GROUP BY date)) t""",
)
Q9_BLOCKERS = [(c, s.replace("mean_coverage < 0.6", "mean_coverage < 0.3").replace("mean_tradable_ratio < 0.5", "mean_tradable_ratio < 0.2")) for c, s in SINGLE_BLOCKERS]
Q9_THRESHOLDS = vd.SingleFactorThresholds(min_coverage=0.3, min_tradable_ratio=0.2)


@query(
    "single_factor_workflow",
    sql_with("q9_m", verdict_sql("q9_m", Q9_BLOCKERS, SINGLE_WARNINGS, SINGLE_EXTERNAL, "factor, round(mean_rank_ic, 6) AS mean_rank_ic, round(ic_ir, 5) AS ic_ir, round(mean_coverage, 7) AS mean_coverage, round(mean_tradable_ratio, 7) AS mean_tradable_ratio, screening_decision, round(adjusted_pvalue, 6) AS adjusted_pvalue, min_fold_train, min_fold_test")),
)
def _(spark, d):
    spec = wk.SingleFactorSpec(factor_fn=lambda p: reversal(p, window=2), horizon=1, universe_rules=RULES, preprocess=wk.Preprocess(**PREP), thresholds=Q9_THRESHOLDS, embargo_periods=1)
    out = wk.run_single_factor_workflow(px(spark, d), spec, **inputs(spark, d))["verdict"]
    cols = ("factor", "mean_rank_ic", "ic_ir", "mean_coverage", "mean_tradable_ratio", "screening_decision", "adjusted_pvalue", "min_fold_train", "min_fold_test", "blocking_issues", "warnings", "verdict")
    return rounded(out.select(*cols), 7, mean_rank_ic=6, ic_ir=5, adjusted_pvalue=6)


@query("single_factor_workflow_neutralized_walk_forward")
def _(spark, d):
    spec = wk.SingleFactorSpec(
        factor_fn=lambda p: reversal(p, window=2), horizon=1, universe_rules=RULES, preprocess=wk.Preprocess(**PREP), label_method="rankpct",
        neutralization=wk.Neutralization(size_col="size_exposure", industry_col="industry", beta_col="beta_exposure"),
        validation_mode="walk_forward", train_size=24, test_size=9, step=6, thresholds=Q9_THRESHOLDS, trial_count=10,
    )
    given = inputs(spark, d)
    expo = neutralization_exposures(
        px(spark, d), fundamentals(spark, d), given["asset_metadata"], window=12, min_periods=8, max_group=given["max_group"]
    )
    return rounded(wk.run_single_factor_workflow(px(spark, d), spec, exposures=expo, **given)["verdict"], 6)


# Composite workflow, followed step by step in SQL.
# No winsorizing here: clipped values tie, and ties of a weighted sum are decided by float noise.
cte(
    "q10_prep", "masked",
    """SELECT * FROM (SELECT date, asset, factor, CASE WHEN count(value) OVER w >= 5 THEN CASE WHEN min(value) OVER w = max(value) OVER w THEN cast(0 as double) ELSE (value - avg(value) OVER w) / stddev_pop(value) OVER w END END AS value
    FROM masked WINDOW w AS (PARTITION BY date, factor)) QUALIFY count(value) OVER (PARTITION BY date, factor) / cast(count(*) OVER (PARTITION BY date, factor) as double) >= 0.2""",
)
pair_ctes("q10", "q10_prep", "fwd1")
mono_ctes("q10", "q10_prep")
corr_ctes("q10_prep", "q10_prep")
inflation_ctes("q10", "q10_prep", "SELECT * FROM q10_prep", 3)
cte(
    "q10_dec", "q10_uni q10_prep_max q10_vif",
    """SELECT u.*, CASE WHEN rank_ic_mean IS NULL OR abs_monotonicity IS NULL THEN 'needs_review' WHEN coverage < 0.2 OR abs_monotonicity < 0.1 THEN 'weak_factor'
    WHEN max_abs_corr > 0.9 OR vif > 10 THEN 'redundant_factor' ELSE 'candidate_factor' END AS decision FROM q10_uni u LEFT JOIN q10_prep_max m ON m.factor = u.factor LEFT JOIN q10_vif v ON v.factor = u.factor""",
)
cte(
    "q10_sel", "q10_dec q10_prep",
    """SELECT p.* FROM q10_prep p SEMI JOIN (SELECT factor FROM (SELECT *, count(*) FILTER (decision = 'candidate_factor') OVER () AS n, row_number() OVER (ORDER BY rank_ic_mean DESC NULLS LAST, coverage DESC, factor) AS k FROM q10_dec)
    WHERE CASE WHEN n >= 2 THEN decision = 'candidate_factor' ELSE k <= 2 END) c ON p.factor = c.factor""",
)
pair_ctes("q10s", "q10_sel", "fwd1")
weight_ctes("q10_w", "avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)", "q10_sel", "q10s_ic")
compose_ctes("q10_c", "q10_sel", "q10_w")
pair_ctes("q10c", "q10_composite", "fwd1")
alpha_ctes("q10_ap", "q10_ac", "q10s_ls")
valid_cte("q10_valid", "q10_composite")
legs_cte("q10_legs", 15, 10, "q10_valid")
rank_weights_cte("q10_pw", "q10_legs")
plan_cte("q10_plan", "q10_pw")
cost_ctes("_q10", "q10_plan")
exposure_ctes("_q10", "q10_pw")
cte(
    "q10_m", "q10c_ic q10_dec q10_ac pen_q10 tcost_q10 ind_x_q10 sty_x_q10",
    """SELECT (SELECT avg(rank_ic) FROM q10c_ic) AS mean_rank_ic, (SELECT avg(ic) / stddev_samp(ic) FROM q10c_ic) AS ic_ir, (SELECT count(*) FROM q10_dec WHERE decision = 'candidate_factor') AS n_selected_factors,
    (SELECT k * k / (k + 2 * s) FROM (SELECT sum(corr * corr) AS s, (1 + sqrt(1 + 8 * cast(count(*) as double))) / 2 AS k FROM q10_ac)) AS effective_breadth, (SELECT avg(abs(corr)) FROM q10_ac) AS avg_abs_corr,
    (SELECT count(*) FILTER (adv_participation > cast(0.05 as double)) / cast(count(*) as double) FROM pen_q10) AS adv_flag_ratio, (SELECT avg(bps) FROM tcost_q10) AS mean_cost_bps,
    (SELECT max(abs(net_weight)) FROM ind_x_q10) AS max_abs_industry_exposure, (SELECT max(abs(weighted_exposure)) FROM sty_x_q10) AS max_abs_style_exposure, true AS has_capacity, true AS has_cost, true AS has_exposure""",
)
_Q10 = dict(mean_rank_ic=6, ic_ir=5, effective_breadth=6, avg_abs_corr=6, adv_flag_ratio=6, mean_cost_bps=4, max_abs_industry_exposure=6, max_abs_style_exposure=5)


@query(
    "composite_workflow",
    sql_with("q10_m", verdict_sql("q10_m", COMP_BLOCKERS, COMP_WARNINGS, COMP_EXTERNAL, "n_selected_factors, " + ", ".join(f"round({c}, {n}) AS {c}" for c, n in _Q10.items()))),
)
def _(spark, d):
    spec = wk.CompositeSpec(
        horizon=1, universe_rules=RULES, preprocess=wk.Preprocess(winsorize=False, min_group_size=5, min_coverage=0.2), screening=dict(min_coverage=0.2, min_abs_monotonicity=0.1, max_pairwise_corr=0.9, max_vif=10.0),
        composite_lookback=12, composite_min_history=5, portfolio=wk.pf.Strategy(long_top_k=15, short_bottom_k=10, weighting_method="rank"),
        portfolio_value=1000000.0, adv_window=6, costs=OPTS,
    )
    # Lines are read once for prices and market states and once for fundamentals, which need the orders.
    prices, values = materialize(px_and_state(spark, d)), materialize(fundamentals(spark, d))
    given = dict(asset_metadata=asset_meta(spark, d), market_state=prices, max_group=assets_per_date(spark, d))
    expo = neutralization_exposures(prices, values, given["asset_metadata"], window=12, min_periods=8)
    out = wk.run_composite_workflow(prices, spec, candidates=signals_of(prices, values), exposure_data=expo, **given)["verdict"]
    return rounded(out.select("n_selected_factors", *_Q10, "blocking_issues", "warnings", "verdict"), 6, **_Q10)


@query("alpha_pool_report", BREADTH)
def _(spark, d):
    return rounded(cp.alpha_pool_diagnostics(alpha_panel(spark, d))["breadth_summary"], 7, effective_breadth=6)
