"""Factor experiment: factor, label, split, evaluation, optional portfolio and report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean
from panelyard.functions.groups import attach_small
from panelyard.functions.storage import materialize
from panelyard.operators import evaluation as ev
from panelyard.operators import portfolio as pf
from panelyard.operators.factors import FactorFn
from panelyard.operators.labels import forward_return
from panelyard.operators.splits import time_split
from panelyard.sources.contracts import validate_factor_output, validate_price_panel


def evaluate_pairs(
    pairs: DataFrame, assignments_of: DataFrame, n_quantiles: int, keys: Sequence[str], max_group: int | None
) -> dict[str, DataFrame]:
    """Per-date metrics of aligned (x, y) rows; ``keys`` come before date and factor."""
    dated = [*keys, "date", "factor"]
    returns = ev.quantile_returns_of_pairs(pairs, n_quantiles, dated, max_group=max_group)
    assigned = ev.with_quantile(assignments_of, "value", n_quantiles, keys=dated, max_group=max_group)
    groups = (*keys, "factor")
    turnover = ev.quantile_turnover(assigned.select(*dated, "asset", "quantile"), groups)
    return {
        "ic": ev.ic_of_pairs(pairs, dated),
        "rank_ic": ev.rank_ic_of_pairs(pairs, dated, max_group=max_group),
        "quantile_returns": returns,
        "long_short": ev.long_short_return(returns, dated),
        "quantile_assignments": assigned.select(*dated, "asset", "quantile"),
        "quantile_turnover": turnover,
        "long_short_turnover": ev.long_short_turnover(turnover, groups),
    }


def summarise_parts(parts: dict[str, DataFrame], by: Sequence[str]) -> DataFrame:
    return ev.summarise(parts["ic"], parts["rank_ic"], parts["long_short"], parts["long_short_turnover"], by)


def run_factor_experiment(
    prices: DataFrame, factor_fn: FactorFn, *, horizon: int = 1, n_quantiles: int = 5, train_end: str | None = None, test_start: str | None = None,
    val_start: str | None = None, strategy: pf.Strategy | None = None, portfolio_cost_rate: float | None = None, generate_factor_report: bool = False,
    validate: bool = False, max_group: int | None = None,
) -> dict[str, DataFrame]:
    """Tables of one experiment (many factors at once if ``factor_fn`` returns many).

    The aligned factor/label rows are written once: every metric reads them. The rest is lazy.
    ``validate`` runs the contracts first, as aggregate actions.
    """
    if (train_end is None) != (test_start is None):
        raise ValueError("train_end and test_start must both be provided or both be omitted")
    factors = factor_fn(prices)
    if validate:
        validate_price_panel(prices)
        validate_factor_output(factors)
    labels = forward_return(prices, horizon=horizon)
    factors = factors.select("date", "asset", "factor", clean("value").alias("value"))
    right = labels.select("date", "asset", F.col("factor").alias("label"), F.col("value").alias("y"))
    rows = factors.join(right, ["date", "asset"], "left")
    if train_end is not None:
        rows = time_split(rows, train_end=train_end, test_start=test_start, val_start=val_start).where("split = 'test'").drop("split")
    rows = materialize(rows)
    evaluated = rows.select("date", "asset", "factor", "value")
    pairs = rows.where("label is not null").select("date", "asset", "factor", F.col("value").alias("x"), "y")
    out = {"factors": evaluated, "labels": labels}
    out.update(evaluate_pairs(pairs, evaluated, n_quantiles, (), max_group))
    out["summary"] = summarise_parts(out, ("factor",))
    out["coverage"] = rows.groupBy("factor").agg(
        F.count_distinct("date").alias("n_eval_dates"),
        F.count_distinct("asset").alias("n_eval_assets"),
        (F.count_distinct("date") - F.count_distinct(F.when(F.col("y").isNotNull(), F.col("date")))).alias("n_label_missing_dates"),
    )
    if strategy is not None:
        one_day = forward_return(prices, horizon=1).select("date", "asset", "value")
        one_day = attach_small(one_day, evaluated.select("factor", "date").distinct(), ["date"], "inner").select("factor", "date", "asset", "value")
        block = pf.portfolio_block(evaluated, one_day, strategy, cost_rate=portfolio_cost_rate, keys=("factor",), max_group=max_group)
        out.update({f"portfolio_{k}": v for k, v in block.items()})
        out["portfolio_summary"] = pf.summarise_portfolio(block, ("factor",))
    if generate_factor_report:
        out["report"] = ev.build_factor_report(prices, evaluated, horizon=horizon, n_quantiles=n_quantiles, max_group=max_group)
    return out


def summary_row(result: dict[str, DataFrame], *, label_name: str, n_quantiles: int, split_description: str = "full_sample", cost_rate: float | None = None) -> DataFrame:
    """The experiment summary with its parameters and, given a cost rate, the mean cost-adjusted spread."""
    s = result["summary"]
    none = F.lit(None).cast("double")
    if cost_rate is None:
        s = s.withColumn("__adj", none)
    else:
        adjusted = ev.cost_adjusted_long_short(result["long_short"], result["long_short_turnover"], cost_rate)
        s = s.join(adjusted.groupBy("factor").agg(F.avg("adjusted_return").alias("__adj")), "factor", "left")
    return s.select(
        F.col("factor").alias("factor_name"), F.lit(label_name).alias("label_name"), F.lit(n_quantiles).alias("n_quantiles"),
        F.lit(split_description).alias("split_description"), "mean_ic", "mean_rank_ic", "ic_ir", "mean_long_short_return", "long_short_hit_rate",
        F.col("n_dates").alias("n_dates_used"), "mean_long_short_turnover", F.lit(cost_rate).cast("double").alias("cost_rate"),
        F.col("__adj").alias("mean_cost_adjusted_long_short_return"),
    )
