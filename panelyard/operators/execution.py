"""Diagnostics of execution tables: weights, orders, skipped orders and equity curves.

``keys`` (usually ("run_id",)) lets one job analyse many runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, ratio
from panelyard.operators.portfolio import dense_grid, weight_changes

# Canonical names of order-skip reasons.
REASON_CODES = {
    "listing_age_or_missing_listing_date": "ipo_age_filter",
    "st_filter": "st_filter",
    "halted_trading": "halted_trading",
    "suspension": "suspension",
    "limit_locked_non_executable": "price_limit_locked",
    "price_limit_lock": "price_limit_locked",
    "min_adv_filter": "min_adv_filter",
    "manual_exclusion": "manual_exclusion",
    "position_sign_flip": "position_sign_flip",
    "same_day_reentry_blocked": "same_day_reentry_blocked",
    "non_positive_or_nan_fill_price": "invalid_price",
    "universe_excluded": "universe_excluded",
    "tradability_excluded": "tradability_excluded",
}
PERIODS_PER_YEAR = 252.0


# Default limits of the impact flags.
@dataclass(frozen=True)
class ImpactThresholds:
    high_execution_deviation_mean_abs: float = 0.02
    severe_tradability_skipped_ratio: float = 0.2
    price_limit_reason_ratio: float = 0.05
    liquidity_reason_ratio: float = 0.1
    reentry_reason_ratio: float = 0.02
    material_turnover_reduction_ratio: float = 0.1


def prepare_weights(weights: DataFrame, keys: Sequence[str] = (), weight_col: str = "target_weight") -> DataFrame:
    """One row per key: duplicate (date, asset) weights are summed."""
    return weights.groupBy(*keys, "date", "asset").agg(F.coalesce(F.sum(clean(weight_col)), F.lit(0.0)).alias("weight"))


def delayed_weights(weights: DataFrame, *, delay: int, weight_col: str = "target_weight") -> DataFrame:
    """Weights in force ``delay`` dates later, on the dense date x asset grid; 0 before the first."""
    rows = prepare_weights(weights, weight_col=weight_col)
    grid = dense_grid(rows).join(rows, ["date", "asset"], "left").withColumn("__w", F.coalesce("weight", F.lit(0.0)))
    own = W.partitionBy("asset").orderBy("date")
    return grid.select("date", "asset", F.coalesce(F.lag("__w", delay).over(own), F.lit(0.0)).alias("executed_weight"))


def weight_turnover(weights: DataFrame, keys: Sequence[str] = (), weight_col: str = "target_weight") -> DataFrame:
    """Half the sum of absolute changes per date; the first date is 0."""
    changes = weight_changes(prepare_weights(weights, keys, weight_col), keys)
    return changes.groupBy(*keys, "date").agg(
        F.when(F.bool_or("is_first"), F.lit(0.0)).otherwise(F.sum("change") / F.lit(2.0)).alias("turnover")
    )


def performance_summary(series: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Return, volatility, Sharpe ratio and drawdown per run from (date, return, equity, turnover).

    A run has one row per date, so the running maximum is bounded by the calendar.
    """
    peak = F.max("equity").over(W.partitionBy(*keys).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    rows = series.withColumn("__dd", ratio(F.col("equity"), peak) - 1)
    r = clean("return")
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"),
        F.avg(r).alias("mean_return"),
        F.stddev_samp(r).alias("volatility"),
        (F.try_divide(F.max_by("equity", "date"), F.min_by("equity", "date")) - 1).alias("total_return"),
        F.min("__dd").alias("max_drawdown"),
        F.avg(clean("turnover")).alias("mean_turnover"),
    )
    sharpe = F.when(F.col("volatility") > 0, F.try_divide(F.sqrt(F.lit(PERIODS_PER_YEAR)) * F.col("mean_return"), F.col("volatility")))
    return stats.select(
        *keys, "n_periods", "mean_return", "volatility", sharpe.alias("sharpe_annualized"), "total_return", "max_drawdown", "mean_turnover"
    )


def normalize_reason_code(c: Column) -> Column:
    """Split on ';', map to canonical names, sort and de-duplicate."""
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(REASON_CODES.items())])
    tokens = F.filter(F.transform(F.split(c, ";"), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    mapped = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(names, t), t))
    joined = F.array_join(F.array_sort(F.array_distinct(mapped)), ";")
    return F.when(F.coalesce(joined, F.lit("")) == "", F.lit("unclassified")).otherwise(joined)


def classify_exclusion_reason(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return (
        F.when(F.contains(text, F.lit("limit")), "price_limit")
        .when(F.contains(text, F.lit("suspend")) | F.contains(text, F.lit("halt")), "suspension")
        .otherwise("unknown")
    )


def reason_distribution(skipped: DataFrame, keys: Sequence[str] = (), *, max_examples: int = 5) -> DataFrame:
    """Count, share and up to five example source reasons per reason code; the most frequent is dominant.

    Examples come from a per-group limit over distinct texts, never from a collected group.
    """
    rows = skipped.withColumn("reason_code", F.trim(F.col("reason_code").cast("string"))).where("reason_code <> ''")
    group = [*keys, "reason_code"]
    counts = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("skipped_order_count"))
    # One row per reason code of a run.
    per_run = W.partitionBy(*keys)
    first = per_run.orderBy(F.col("skipped_order_count").desc(), F.col("reason_code").asc())
    counts = counts.withColumns(
        {
            "skipped_order_ratio": ratio(F.col("skipped_order_count"), F.sum("skipped_order_count").over(per_run)),
            "is_dominant": F.row_number().over(first) == 1,
        }
    )
    if "source_reason" not in skipped.columns:
        return counts.withColumn("source_reason_examples", F.col("reason_code"))
    texts = rows.select(*group, F.trim(F.col("source_reason").cast("string")).alias("s")).where("s <> ''").distinct()
    few = texts.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy("s"))).where(F.col("__k") <= max_examples)
    examples = few.groupBy(*group).agg(F.array_join(F.array_sort(F.collect_list("s")), ";").alias("source_reason_examples"))
    return counts.join(examples, group, "left")


def execution_deviation(target: DataFrame, executed: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Target against executed weights by date and overall; a missing weight is 0."""
    left = prepare_weights(target, keys).withColumnRenamed("weight", "t")
    right = prepare_weights(executed, keys).withColumnRenamed("weight", "e")
    both = left.join(right, [*keys, "date", "asset"], "full_outer").withColumns(
        {"t": F.coalesce("t", F.lit(0.0)), "e": F.coalesce("e", F.lit(0.0))}
    )
    diff = F.abs(F.col("t") - F.col("e"))
    by_date = both.groupBy(*keys, "date").agg(
        F.sum(F.abs("t")).alias("target_gross"), F.sum(F.abs("e")).alias("realized_gross"), F.avg(diff).alias("mean_abs_weight_diff"),
        F.max(diff).alias("max_abs_weight_diff"), F.sum(diff).alias("__s"), F.count(F.lit(1)).alias("__n"),
    ).withColumn("gross_abs_diff", F.abs(F.col("target_gross") - F.col("realized_gross")))
    summary = by_date.groupBy(*keys).agg(
        F.try_divide(F.sum("__s"), F.sum("__n").cast("double")).alias("mean_abs_weight_diff"),
        F.max("max_abs_weight_diff").alias("max_abs_weight_diff"),
        F.avg("target_gross").alias("target_gross_mean"),
        F.avg("realized_gross").alias("realized_gross_mean"),
        F.avg("gross_abs_diff").alias("gross_abs_diff_mean"),
        F.max("gross_abs_diff").alias("gross_abs_diff_max"),
    )
    cols = ("target_gross", "realized_gross", "gross_abs_diff", "mean_abs_weight_diff", "max_abs_weight_diff")
    return {"by_date": by_date.select(*keys, "date", *cols), "summary": summary}


def turnover_effect(
    target: DataFrame, executed: DataFrame, orders: DataFrame, skipped: DataFrame, *, thresholds: ImpactThresholds | None = None
) -> DataFrame:
    """One row: mean turnover of target and execution, its reduction, and the share of skipped orders."""
    limits = thresholds or ImpactThresholds()
    base = weight_turnover(target).agg(F.avg("turnover").alias("target_mean_turnover")).withColumns(
        {
            "realized_mean_turnover": weight_turnover(executed).agg(F.avg("turnover")).scalar(),
            "n_orders": orders.agg(F.count(F.lit(1))).scalar(),
            "n_skipped_orders": skipped.agg(F.count(F.lit(1))).scalar(),
        }
    )
    cut = F.col("target_mean_turnover") - F.col("realized_mean_turnover")
    share = F.when(F.abs("target_mean_turnover") > F.lit(1e-12), F.try_divide(cut, F.col("target_mean_turnover")))
    tries = F.col("n_orders") + F.col("n_skipped_orders")
    return base.withColumns(
        {
            "turnover_reduction": cut,
            "turnover_reduction_ratio": share,
            "skipped_order_ratio": F.coalesce(ratio(F.col("n_skipped_orders"), tries), F.lit(0.0)),
        }
    ).withColumn("material_turnover_reduction", F.col("turnover_reduction_ratio") >= F.lit(limits.material_turnover_reduction_ratio))


def impact_flags(reasons: DataFrame, deviation_summary: DataFrame, turnover: DataFrame, *, thresholds: ImpactThresholds | None = None) -> DataFrame:
    """(flag, observed, observed_text, threshold, triggered) of one run; inputs have a handful of rows."""
    limits = thresholds or ImpactThresholds()

    def share(code: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("reason_code") == code, F.col("skipped_order_ratio"))), F.lit(0.0))

    seen = reasons.agg(
        F.max(F.when(F.col("is_dominant"), F.col("reason_code"))).alias("blocker"),
        share("price_limit_locked").alias("limit"), share("min_adv_filter").alias("adv"), share("same_day_reentry_blocked").alias("reentry"),
    ).withColumns(
        {
            "deviation": deviation_summary.select("mean_abs_weight_diff").scalar(),
            "skipped": turnover.select("skipped_order_ratio").scalar(),
        }
    )

    def row(flag: str, column: str, limit: float) -> Column:
        return F.struct(
            F.lit(flag).alias("flag"), F.col(column).alias("observed"), F.lit(None).cast("string").alias("observed_text"),
            F.lit(limit).alias("threshold"), (F.col(column) >= F.lit(limit)).alias("triggered"),
        )

    none = F.lit(None).cast("double")
    dominant = F.struct(
        F.lit("dominant_execution_blocker").alias("flag"), none.alias("observed"), F.col("blocker").alias("observed_text"), none.alias("threshold"),
        F.col("blocker").isNotNull().alias("triggered"),
    )
    return seen.select(F.inline(F.array(
        dominant,
        row("high_execution_deviation", "deviation", limits.high_execution_deviation_mean_abs),
        row("severe_tradability_constraints", "skipped", limits.severe_tradability_skipped_ratio),
        row("price_limit_sensitive", "limit", limits.price_limit_reason_ratio),
        row("liquidity_sensitive", "adv", limits.liquidity_reason_ratio),
        row("reentry_constraint_sensitive", "reentry", limits.reentry_reason_ratio),
    )))


def build_execution_impact_report(
    target: DataFrame, executed: DataFrame, orders: DataFrame, skipped: DataFrame, *, thresholds: ImpactThresholds | None = None
) -> dict[str, DataFrame]:
    reasons = reason_distribution(skipped)
    deviation = execution_deviation(target, executed)
    turnover = turnover_effect(target, executed, orders, skipped, thresholds=thresholds)
    return {
        "reasons": reasons,
        "deviation": deviation["summary"],
        "timeseries": deviation["by_date"],
        "turnover_effect": turnover,
        "flags": impact_flags(reasons, deviation["summary"], turnover, thresholds=thresholds),
    }


def compare_runs(primary: tuple[DataFrame, DataFrame, DataFrame], other: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(metric, primary, comparison) for two runs given as (target, executed, performance row).

    ``target_weights_equal`` is 1 when neither multiset difference of the targets has a row.
    """

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        left, right = prepare_weights(a), prepare_weights(b)
        return left.exceptAll(right).unionByName(right.exceptAll(left)).agg((F.count(F.lit(1)) == 0).cast("double"))

    names = ("total_return", "sharpe_annualized", "max_drawdown", "mean_turnover")
    devs = ("mean_abs_weight_diff", "max_abs_weight_diff")

    def metrics(run: tuple[DataFrame, DataFrame, DataFrame], value: str) -> DataFrame:
        dev = execution_deviation(run[0], run[1])["summary"]
        out = None
        for df, cols in ((run[2], names), (dev, devs)):
            pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(value)) for c in cols])
            part = df.select(F.inline(pairs))
            out = part if out is None else out.unionByName(part)
        return out

    same = differing(primary[0], other[0]).toDF("primary").select(
        F.lit("target_weights_equal").alias("metric"), "primary", F.col("primary").alias("comparison")
    )
    return metrics(primary, "primary").join(metrics(other, "comparison"), "metric").unionByName(same)
