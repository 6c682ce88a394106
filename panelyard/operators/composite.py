"""Composite signals and diagnostics of a pool of alphas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, gated
from panelyard.functions.groups import attach, attach_small
from panelyard.functions.storage import materialize
from panelyard.operators.evaluation import aligned, compute_rank_ic, long_short_return, quantile_returns_of_pairs
from panelyard.operators.screening import MAX_SERIES, effective_count, pairwise_correlation, series_names

METHODS = ("equal", "ic", "icir")


def ic_history(signals: DataFrame, labels: DataFrame, *, max_group: int | None = None, validate: bool = True) -> DataFrame:
    return compute_rank_ic(signals, labels, max_group=max_group, validate=validate).select("date", "factor", "rank_ic")


def composite_weights(
    signals: DataFrame, *, method: str = "equal", labels: DataFrame | None = None, lookback: int = 63, min_history: int = 5,
    label_lag: int = 0, max_group: int | None = None, validate: bool = True, history: DataFrame | None = None,
) -> DataFrame:
    """Weight per (date, factor): equal, or by the IC (IR) of the last ``lookback`` IC rows before the date.

    The history holds IC rows strictly before the date. An IC dated t - 1 with horizon h uses
    prices up to t - 1 + h; ``label_lag`` = h - 1 skips that many of the latest rows and makes
    the weights point-in-time. The window runs per factor over dates, not over assets. ``history``, the result of
    ``ic_history`` of these signals and maybe others, isn't taken again.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if lookback <= 0 or min_history <= 0:
        raise ValueError("lookback and min_history must be > 0")
    dates = signals.select("date").distinct().withColumn("__names", series_names(signals).scalar())
    grid = dates.select("date", F.size("__names").cast("double").alias("__k"), F.explode("__names").alias("factor"))
    even = F.lit(1.0) / F.col("__k")
    if method == "equal":
        return grid.select("date", "factor", even.alias("weight"))
    if history is None:
        if labels is None:
            raise ValueError(f"labels is required when method={method!r}")
        history = ic_history(signals, labels, max_group=max_group, validate=validate)
    history = history.select("date", "factor", "rank_ic", F.lit(1).alias("__has"))
    before = W.partitionBy("factor").orderBy("date").rowsBetween(W.unboundedPreceding, -1)
    rows = grid.join(history, ["date", "factor"], "left").withColumn("__i", F.coalesce(F.count("__has").over(before), F.lit(0)))
    # Position among IC rows: rows between position - lookback and position - 1.
    past = W.partitionBy("factor").orderBy("__i").rangeBetween(-(lookback + label_lag), -(1 + label_lag))
    mean, n = F.avg("rank_ic").over(past), F.count("__has").over(past)
    if method == "ic":
        score = mean
    else:
        sd = F.stddev_samp("rank_ic").over(past)
        score = F.when(sd > 0, F.try_divide(mean, sd))
    scored = rows.select("date", "factor", "__k", gated(score, n, min_history).alias("__s"))
    scored = scored.withColumn("__s", F.when(F.col("__s").isNotNull(), F.greatest("__s", F.lit(0.0))))
    # k rows per date.
    total = F.coalesce(F.sum("__s").over(W.partitionBy("date")), F.lit(0.0))
    weight = F.when(total > 0, F.coalesce(F.try_divide(F.col("__s"), total), F.lit(0.0))).otherwise(even)
    return scored.select("date", "factor", weight.alias("weight"))


def compose_signals(
    signals: DataFrame, *, method: str = "equal", labels: DataFrame | None = None, lookback: int = 63, min_history: int = 5,
    output_factor: str = "composite_signal", label_lag: int = 0, max_group: int | None = None, validate: bool = True, history: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Weighted mean of per-date z-scores over the factors an asset has.

    A factor with fewer than two values on a date has no z-score there; a constant one is 0
    for every asset of the date, so its weight counts in every denominator.
    """
    # A row per date and factor, which several branches read: without the table each of them would rank the panel.
    weights = materialize(composite_weights(
        signals, method=method, labels=labels, lookback=lookback, min_history=min_history, label_lag=label_lag, max_group=max_group,
        validate=validate, history=history,
    ))
    keys = ["date", "factor"]
    v = clean("value")
    stats = signals.groupBy(*keys).agg(
        F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"), F.count(v).alias("n"), (F.min(v) == F.max(v)).alias("flat")
    ).where("n >= 2")
    side = materialize(stats.join(weights, keys))
    constant = side.where("flat").groupBy("date").agg(F.sum(F.abs("weight")).alias("__c"))
    varying = side.where("not flat").select(*keys, "mu", "sd", "weight")
    rows = attach_small(signals.select(*keys, "asset", v.alias("v")), varying, keys)
    part = F.try_divide(F.col("v") - F.col("mu"), F.col("sd")) * F.col("weight")
    rows = rows.withColumn("__part", part)
    per_asset = attach(rows.groupBy("date", "asset").agg(
        F.coalesce(F.sum("__part"), F.lit(0.0)).alias("__sum"),
        F.coalesce(F.sum(F.when(F.col("__part").isNotNull(), F.abs("weight"))), F.lit(0.0)).alias("__abs"),
        F.count("__part").alias("__n"),
    ), constant, ["date"])
    composite = per_asset.where((F.col("__n") > 0) | F.col("__c").isNotNull()).select(
        "date", "asset", F.lit(output_factor).alias("factor"),
        F.try_divide(F.col("__sum"), F.nullif(F.col("__abs") + F.coalesce("__c", F.lit(0.0)), F.lit(0.0))).alias("value"),
    )
    attribution = rows.where(F.col("__part").isNotNull()).groupBy(*keys).agg(F.avg(F.abs("__part")).alias("mean_abs_component")).unionByName(
        side.where("flat").select(*keys, F.lit(0.0).alias("mean_abs_component"))
    )
    diagnostics = composite.groupBy("date").agg(
        F.count_distinct("asset").alias("n_assets"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage")
    ).withColumn("n_factors", F.size(series_names(signals).scalar()))
    return {
        "composite": composite,
        "weights": weights,
        "diagnostics": diagnostics.select("date", "n_assets", "n_factors", "coverage"),
        "attribution": attribution,
    }


def alpha_return_panel(signals: DataFrame, labels: DataFrame, *, n_quantiles: int = 5, max_group: int | None = None, validate: bool = True) -> DataFrame:
    """Long-short return per (date, factor); dates without any value are dropped, gaps are 0."""
    return alpha_returns_of_pairs(aligned(signals, labels, validate=validate), n_quantiles=n_quantiles, max_group=max_group)


def alpha_returns_of_pairs(pairs: DataFrame, *, n_quantiles: int = 5, max_group: int | None = None) -> DataFrame:
    """``alpha_return_panel`` of aligned pairs; the returns, a row per date and factor, are written once."""
    ls = materialize(long_short_return(quantile_returns_of_pairs(pairs, n_quantiles, ["date", "factor"], max_group=max_group)))
    used = ls.groupBy("date").agg(F.max(F.col("long_short_return").isNotNull()).alias("any")).where("any").select("date")
    grid = used.withColumn("__names", series_names(ls).scalar()).select("date", F.explode("__names").alias("factor"))
    return grid.join(ls, ["date", "factor"], "left").select(
        "date", "factor", F.coalesce("long_short_return", F.lit(0.0)).alias("value")
    )


def panel_names(panel: DataFrame) -> list[str]:
    """Names of a pool of alphas; more than ``MAX_SERIES`` raise."""
    names = [r[0] for r in panel.select("factor").distinct().orderBy("factor").limit(MAX_SERIES + 1).collect()]
    if len(names) > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} alphas in a pool")
    return names


def alpha_correlations(panel: DataFrame) -> DataFrame:
    """Correlation of every two alphas over dates."""
    pairs = pairwise_correlation(panel, keys=("date",))
    return pairs.select(F.col("a").alias("alpha_a"), F.col("b").alias("alpha_b"), "corr", F.abs("corr").alias("abs_corr"))


def breadth_summary(pairs: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Breadth of the alphas in ``names``, or else of those that occur in a pair; a pool of one has no pair."""
    eff = effective_count(pairs, name_cols=("alpha_a", "alpha_b"), names=names)
    return eff.select(
        F.col("n").alias("n_alphas"), F.coalesce("avg_abs_corr", F.lit(0.0)).alias("avg_abs_corr"), F.col("effective_n").alias("effective_breadth"),
        F.try_divide(F.col("effective_n"), F.col("n").cast("double")).alias("breadth_ratio"), F.sqrt("effective_n").alias("ir_multiplier_bound"),
    )


def correlation_clusters(
    pairs: DataFrame, *, threshold: float = 0.8, name_cols: tuple[str, str] = ("alpha_a", "alpha_b"), names: Sequence[str] | None = None
) -> DataFrame:
    """Connected components of |correlation| >= threshold: name, cluster_id (in order of the first member).

    ``names`` adds series that occur in no pair, each a cluster of its own.

    Labels start as the own name and repeatedly take the smallest label of the neighbours, then
    of the label's own label, until nothing changes. Every round is written to shared storage.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    a, b = name_cols
    known = pairs.select(F.explode(F.array(a, b)).alias("name"))
    if names is not None:
        known = known.unionByName(pairs.sparkSession.createDataFrame([(n,) for n in names], "name string"))
    names = known.distinct()
    linked = pairs.where(F.abs("corr") >= threshold)
    edges = materialize(linked.select(F.inline(F.array(
        F.struct(F.col(a).alias("name"), F.col(b).alias("other")), F.struct(F.col(b).alias("name"), F.col(a).alias("other"))
    ))))
    labels = materialize(names.withColumn("label", F.col("name")))
    while True:
        near = edges.join(labels.select(F.col("name").alias("other"), "label"), "other").groupBy("name").agg(F.min("label").alias("near"))
        step = labels.join(near, "name", "left").select("name", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        jump = labels.select(F.col("name").alias("label"), F.col("label").alias("up"))
        step = materialize(step.join(jump, "label").select("name", "old", F.least("label", "up").alias("label")))
        labels = step.select("name", "label")
        if step.where("label <> old").isEmpty():
            break
    # One row per cluster, at most one per series.
    roots = labels.select("label").distinct().withColumn("cluster_id", F.row_number().over(W.orderBy("label")) - 1)
    return labels.join(roots, "label").select("name", "cluster_id")


def cluster_summary(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_alphas"), F.array_join(F.array_sort(F.collect_list("name")), "|").alias("members")
    )


def alpha_pool_diagnostics(panel: DataFrame, *, cluster_threshold: float = 0.8) -> dict[str, DataFrame]:
    names = panel_names(panel)
    pairs = materialize(alpha_correlations(panel))
    return {
        "pairwise": pairs,
        "breadth_summary": breadth_summary(pairs, names),
        "clusters": cluster_summary(correlation_clusters(pairs, threshold=cluster_threshold, names=names)),
    }
