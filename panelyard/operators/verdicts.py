"""Promotion verdicts and cadence recommendations over tables with one row per candidate."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Default thresholds of the verdicts.
@dataclass(frozen=True)
class SingleFactorThresholds:
    min_rank_ic_registry: float = 0.01
    min_ic_ir_registry: float = 0.1
    min_rank_ic_external: float = 0.02
    min_ic_ir_external: float = 0.2
    min_coverage: float = 0.6
    min_tradable_ratio: float = 0.5
    max_adjusted_pvalue_external: float = 0.1


@dataclass(frozen=True)
class CompositeThresholds:
    min_selected_factors: int = 2
    min_rank_ic_registry: float = 0.01
    min_ic_ir_registry: float = 0.1
    min_rank_ic_external: float = 0.02
    min_ic_ir_external: float = 0.2
    min_effective_breadth_registry: float = 1.2
    min_effective_breadth_external: float = 1.6
    max_avg_abs_corr_external: float = 0.7
    max_adv_flag_ratio_external: float = 0.15
    max_mean_cost_bps_external: float = 25.0
    max_abs_industry_exposure_external: float = 0.25
    max_abs_style_exposure_external: float = 0.3


def _listed(found: Mapping[str, Column]) -> Column:
    codes = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in found.items()]))
    return F.array_join(F.array_sort(F.array_distinct(codes)), "|")


def _below(column: str, limit: float) -> Column:
    """Missing or below the limit."""
    return F.coalesce(F.col(column) < F.lit(float(limit)), F.lit(True))


def _conclude(df: DataFrame, blockers: Mapping[str, Column], warnings: Mapping[str, Column], external: Column) -> DataFrame:
    out = df.withColumns({"blocking_issues": _listed(blockers), "warnings": _listed(warnings)})
    blocked, warned = F.col("blocking_issues") != "", F.col("warnings") != ""
    ready = F.coalesce(external, F.lit(False)) & ~warned

    def choose(a: str, b: str, c: str, e: str) -> Column:
        return F.when(blocked, a).when(ready, b).when(warned, c).otherwise(e)

    return out.withColumns(
        {
            "verdict": choose("reject", "candidate_for_external_backtest", "needs_review", "candidate_for_registry"),
            "reason": choose(
                "one_or_more_hard_gates_failed", "all_external_gates_passed", "soft_gates_require_manual_review", "registry_gates_passed"
            ),
        }
    )


def single_factor_verdict(metrics: DataFrame, thresholds: SingleFactorThresholds | None = None) -> DataFrame:
    """Columns read: mean_rank_ic, ic_ir, mean_coverage, mean_tradable_ratio, screening_decision,
    adjusted_pvalue, min_fold_train, min_fold_test (the last two NULL without validation folds)."""
    t = thresholds or SingleFactorThresholds()
    # Codes of blocking issues and warnings.
    blockers = {
        "mean_rank_ic_below_registry_threshold": _below("mean_rank_ic", t.min_rank_ic_registry),
        "ic_ir_below_registry_threshold": _below("ic_ir", t.min_ic_ir_registry),
        "coverage_below_threshold": _below("mean_coverage", t.min_coverage),
        "tradable_ratio_below_threshold": _below("mean_tradable_ratio", t.min_tradable_ratio),
        "factor_screening_not_candidate": F.coalesce(F.col("screening_decision") != "candidate_factor", F.lit(True)),
        "validation_fold_without_train_samples": F.col("min_fold_train") <= 0,
        "validation_fold_without_test_samples": F.col("min_fold_test") <= 0,
    }
    high_p = F.col("adjusted_pvalue") > F.lit(t.max_adjusted_pvalue_external)
    warnings = {"multiple_testing_adjusted_pvalue_above_external_threshold": high_p}
    external = (F.col("mean_rank_ic") >= t.min_rank_ic_external) & (F.col("ic_ir") >= t.min_ic_ir_external)
    return _conclude(metrics, blockers, warnings, external & ~F.coalesce(high_p, F.lit(False)))


def composite_verdict(metrics: DataFrame, thresholds: CompositeThresholds | None = None) -> DataFrame:
    """Columns read: mean_rank_ic, ic_ir, n_selected_factors, effective_breadth, avg_abs_corr, adv_flag_ratio,
    mean_cost_bps, max_abs_industry_exposure, max_abs_style_exposure, has_capacity, has_cost, has_exposure."""
    t = thresholds or CompositeThresholds()
    # Codes of blocking issues and warnings.
    blockers = {
        "insufficient_selected_factors": F.col("n_selected_factors") < t.min_selected_factors,
        "composite_rank_ic_below_registry_threshold": _below("mean_rank_ic", t.min_rank_ic_registry),
        "composite_ic_ir_below_registry_threshold": _below("ic_ir", t.min_ic_ir_registry),
        "effective_breadth_below_registry_threshold": _below("effective_breadth", t.min_effective_breadth_registry),
    }
    warnings = {
        "capacity_diagnostics_missing": ~F.col("has_capacity"),
        "cost_diagnostics_missing": ~F.col("has_cost"),
        "exposure_diagnostics_missing": ~F.col("has_exposure"),
    }

    def within(column: str, limit: float) -> Column:
        """A missing (or infinite) observation does not hold a candidate back."""
        c = F.col(column)
        return c.isNull() | (c == float("inf")) | (c <= F.lit(float(limit)))

    external = (
        (F.col("mean_rank_ic") >= t.min_rank_ic_external) & (F.col("ic_ir") >= t.min_ic_ir_external)
        & (F.col("effective_breadth") >= t.min_effective_breadth_external) & (F.col("avg_abs_corr") <= t.max_avg_abs_corr_external)
        & within("adv_flag_ratio", t.max_adv_flag_ratio_external) & within("mean_cost_bps", t.max_mean_cost_bps_external)
        & within("max_abs_industry_exposure", t.max_abs_industry_exposure_external) & within("max_abs_style_exposure", t.max_abs_style_exposure_external)
    )
    return _conclude(metrics, blockers, warnings, external)


def recommend_rebalance_cadence(
    df: DataFrame, *, half_life_col: str = "half_life_periods", turnover_col: str | None = None, min_periods: int = 1, max_periods: int = 63
) -> DataFrame:
    """Cadence of about half the half-life (5 without one), its label and warnings."""
    if min_periods <= 0 or max_periods < min_periods:
        raise ValueError("min_periods must be > 0 and max_periods >= min_periods")
    hl = F.col(half_life_col).cast("double")
    turn = F.col(turnover_col).cast("double") if turnover_col else F.lit(None).cast("double")
    known = hl.isNotNull()
    periods = F.bround(F.greatest(F.lit(float(min_periods)), F.least(F.lit(float(max_periods)), hl / F.lit(2.0)))).cast("int")
    out = df.withColumn("cadence_periods", F.when(known, periods).otherwise(F.lit(5)))
    n = F.col("cadence_periods")
    label = F.when(n <= 2, "daily_or_2day").when(n <= 7, "weekly").when(n <= 15, "biweekly").when(n <= 31, "monthly").otherwise("slow_monthly_plus")
    warnings = {
        "signal_half_life_is_very_short": hl < 3,
        "signal_half_life_is_slow_moving": hl > 40,
        "high_turnover_and_fast_cadence_execution_risk": (turn > 4.0) & (n <= 3),
        "turnover_is_high_consider_trade_buffer": (turn > 2.0) & (n <= 5),
    }
    return out.withColumns({"cadence_label": label, "warnings": _listed(warnings)})


def campaign_summary(packages: DataFrame) -> DataFrame:
    """(section, name, n) over a package table: verdict counts, blocker counts and top candidates.

    Columns read: case_id, verdict, readiness, dominant_blocker.
    """
    counts = packages.groupBy(F.col("verdict").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit("verdict"))
    blocked = packages.where("dominant_blocker is not null and dominant_blocker <> ''")
    blockers = blocked.groupBy(F.col("dominant_blocker").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("section", F.lit("execution_blocker"))
    ready = F.col("verdict").isin("candidate_for_registry", "candidate_for_external_backtest") & (F.col("readiness") != "blocked")
    top = packages.where(ready).select(F.lit("top_candidate").alias("section"), F.col("case_id").alias("name"), F.lit(1).cast("long").alias("n"))
    return counts.unionByName(blockers).unionByName(top).select("section", "name", "n")
