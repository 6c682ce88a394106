"""Walk-forward experiment: all folds in one job, with the fold as a column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean
from panelyard.functions.storage import materialize
from panelyard.operators import evaluation as ev
from panelyard.operators import portfolio as pf
from panelyard.operators.factors import FactorFn
from panelyard.operators.labels import regression_forward_label
from panelyard.operators.splits import fold_windows, walk_forward_split, with_fold
from panelyard.plans.experiment import evaluate_pairs, summarise_parts

KEY = ("fold_id",)


def _fold_labels(prices: DataFrame, horizon: int) -> DataFrame:
    return regression_forward_label(prices, horizon=horizon).select("date", "asset", F.col("label_value").alias("y"), "event_end")


def run_walk_forward_experiment(
    prices: DataFrame, factor_fn: FactorFn, *, train_size: int, test_size: int, step: int, horizon: int = 1, n_quantiles: int = 5,
    val_size: int = 0, cost_rate: float | None = None, strategy: pf.Strategy | None = None, portfolio_cost_rate: float | None = None,
    max_group: int | None = None,
) -> dict[str, DataFrame]:
    """Per-fold summary, pooled out-of-sample series and aggregate statistics.

    A factor reads the past only, so it is computed once. A label that reaches beyond the end
    of a fold's test window is NULL in that fold, as if prices ended there. Purge and embargo
    sizes are descriptive in a walk-forward scheme; use the purged splits to drop samples.
    """
    folds = walk_forward_split(prices, train_size=train_size, test_size=test_size, step=step, val_size=val_size)
    windows = fold_windows(folds)
    factors = factor_fn(prices).select("date", "asset", "factor", clean("value").alias("value"))
    # At most one row per fold.
    ends = windows.select("fold_id", F.col("test_end").alias("__end"))
    dated = materialize(folds.join(ends, "fold_id"))  # the end travels with (date, fold), so the panel isn't moved on fold_id
    rows = with_fold(factors, dated, carry=("__end",)).join(_fold_labels(prices, horizon), ["date", "asset"], "left")
    rows = materialize(rows.withColumn("y", F.when(F.col("event_end") <= F.col("__end"), F.col("y"))).drop("event_end", "__end"))
    evaluated = rows.select("fold_id", "date", "asset", "factor", "value")
    pairs = rows.select("fold_id", "date", "asset", "factor", F.col("value").alias("x"), "y")
    parts = evaluate_pairs(pairs, evaluated, n_quantiles, KEY, max_group)
    summary = summarise_parts(parts, KEY)
    if cost_rate is None:
        summary = summary.withColumn("mean_cost_adjusted_return", F.lit(None).cast("double"))
    else:
        adjusted = ev.cost_adjusted_long_short(parts["long_short"], parts["long_short_turnover"], cost_rate, ("fold_id", "date", "factor"))
        summary = summary.join(adjusted.groupBy("fold_id").agg(F.avg("adjusted_return").alias("mean_cost_adjusted_return")), "fold_id", "left")
    out = {"folds": folds, "fold_windows": windows, "pooled_ic": parts["ic"].select("fold_id", "date", "ic"), **parts}
    portfolio_cols = ("mean_portfolio_return", "portfolio_hit_rate", "mean_portfolio_turnover", "mean_cost_adjusted_return")
    if strategy is not None:
        daily = with_fold(_fold_labels(prices, 1), dated, carry=("__end",))
        daily = daily.select("fold_id", "date", "asset", F.when(F.col("event_end") <= F.col("__end"), F.col("y")).alias("value"))
        block = pf.portfolio_block(evaluated, daily, strategy, cost_rate=portfolio_cost_rate, keys=KEY, max_group=max_group)
        out.update({"pooled_portfolio_returns": block["returns"], "pooled_portfolio_turnover": block["turnover"]})
        if portfolio_cost_rate is not None:
            out["pooled_cost_adjusted"] = block["cost_adjusted"]
        stats = pf.summarise_portfolio(block, KEY).select(
            "fold_id", *[F.col(c).alias("mean_cost_adjusted_portfolio_return" if c == "mean_cost_adjusted_return" else c) for c in portfolio_cols]
        )
        summary = summary.join(stats, "fold_id", "left")
    else:
        summary = summary.withColumns(
            {("mean_cost_adjusted_portfolio_return" if c == "mean_cost_adjusted_return" else c): F.lit(None).cast("double") for c in portfolio_cols}
        )
    named = windows.join(summary, "fold_id", "left").select(
        "fold_id", "train_start", "train_end", F.col("test_start").alias("start_date"), F.col("test_end").alias("end_date"), "mean_ic", "mean_rank_ic",
        "ic_ir", F.col("mean_long_short_return").alias("mean_long_short"), F.col("mean_long_short_turnover").alias("mean_turnover"),
        "mean_cost_adjusted_return", "mean_portfolio_return", "portfolio_hit_rate", "mean_portfolio_turnover", "mean_cost_adjusted_portfolio_return",
    )
    out["fold_summary"] = named
    out["aggregate"] = aggregate(named, out)
    return out


def aggregate(fold_summary: DataFrame, pooled: dict[str, DataFrame]) -> DataFrame:
    """One row: mean and deviation of the fold metrics, best and worst fold, pooled statistics."""
    spread = ("mean_ic", "ic_ir", "mean_long_short", "mean_turnover", "mean_cost_adjusted_return", "mean_portfolio_return", "mean_cost_adjusted_portfolio_return")
    names = {"mean_ic": "ic", "ic_ir": "ic_ir", "mean_long_short": "long_short", "mean_turnover": "turnover", "mean_cost_adjusted_return": "cost_adjusted_return",
             "mean_portfolio_return": "portfolio_return", "mean_cost_adjusted_portfolio_return": "cost_adjusted_portfolio_return"}
    aggs = [F.count(F.lit(1)).alias("n_folds")]
    for c in spread:
        aggs += [F.avg(c).alias(f"mean_{names[c]}"), F.stddev_samp(c).alias(f"std_{names[c]}")]
    aggs += [F.avg("portfolio_hit_rate").alias("portfolio_hit_rate"), F.avg("mean_portfolio_turnover").alias("mean_portfolio_turnover")]
    known = F.col("mean_ic").isNotNull()
    # Ties go to the first fold; without any IC the first and the last fold are named.
    best = F.max_by("fold_id", F.when(known, F.struct(F.col("mean_ic"), -F.col("fold_id"))))
    worst = F.min_by("fold_id", F.when(known, F.struct(F.col("mean_ic"), F.col("fold_id"))))
    aggs += [F.coalesce(best, F.min("fold_id")).alias("best_fold"), F.coalesce(worst, F.max("fold_id")).alias("worst_fold")]
    ic = pooled["pooled_ic"].agg(F.struct(F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"), F.count("ic").alias("n"))).scalar()
    out = fold_summary.agg(*aggs).withColumn("__i", ic).withColumns(
        {
            "pooled_ic_mean": F.col("__i.m"), "pooled_ic_std": F.col("__i.s"), "pooled_ic_ir": F.try_divide(F.col("__i.m"), F.col("__i.s")),
            "n_ic_obs": F.col("__i.n"),
        }
    ).drop("__i")
    for key, col, name in (
        ("pooled_portfolio_returns", "portfolio_return", "pooled_portfolio_return"), ("pooled_cost_adjusted", "adjusted_return", "pooled_cost_adjusted_return"),
        ("pooled_portfolio_turnover", "portfolio_turnover", "pooled_portfolio_turnover"),
    ):
        if key in pooled:
            v = F.col(col)
            stats = pooled[key].agg(F.struct(
                F.avg(v).alias("m"), F.stddev_samp(v).alias("s"), F.avg(F.when(v.isNotNull(), (v > 0).cast("double"))).alias("h"), F.count(v).alias("n")
            )).scalar()
            out = out.withColumn("__p", stats).withColumns(
                {f"{name}_mean": F.col("__p.m"), f"{name}_std": F.col("__p.s"), f"{name}_hit_rate": F.col("__p.h"), f"n_{name}_obs": F.col("__p.n")}
            ).drop("__p")
    return out
