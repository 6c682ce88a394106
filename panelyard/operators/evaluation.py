"""Cross-sectional evaluation of factors against labels.

Tables may hold many factors; every statistic is keyed by (date, factor, ...), so one job
evaluates all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, gated, pair_corr, ratio
from panelyard.functions.groups import attach_small, dealt, fits, with_ranks
from panelyard.functions.storage import materialize, written_rows
from panelyard.operators.factors import positive_close
from panelyard.sources.contracts import require_unique_tables

DECAY_HORIZONS = (1, 2, 5, 10, 20)


def align(factors: DataFrame, labels: DataFrame, *, validate: bool = True) -> DataFrame:
    """Inner join on (date, asset): columns date, asset, factor, label, x, y.

    A repeated key would multiply pairs, so it raises, unless the caller has checked and turns ``validate`` off.
    """
    if validate:
        require_unique_tables({"factors": factors, "labels": labels}, ("date", "asset", "factor"))
    left = factors.select("date", "asset", "factor", clean("value").alias("x"))
    right = labels.select("date", "asset", F.col("factor").alias("label"), clean("value").alias("y"))
    rows = written_rows(factors)
    return dealt(left, ["date", "asset"], rows).join(dealt(right, ["date", "asset"], rows), ["date", "asset"])


def aligned(factors: DataFrame, labels: DataFrame, *, validate: bool = True) -> DataFrame:
    """``align`` written once, for statistics that read the pairs several times."""
    return materialize(align(factors, labels, validate=validate))


def _by_group(pairs: DataFrame, keys: Sequence[str], max_group: int | None, split_rows: int | None = None) -> DataFrame:
    """Written pairs dealt by ``keys`` where each group is ranked in one task; others are dealt by the ranking itself."""
    return dealt(pairs, keys, written_rows(pairs)) if fits(max_group, split_rows) else pairs


def ic_of_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(pair_corr(F.col("x"), F.col("y")).alias("ic"))


def rank_ic_of_pairs(
    pairs: DataFrame, keys: Sequence[str], *, max_group: int | None = None, split_rows: int | None = None, row_id: Sequence[str] = ("asset",)
) -> DataFrame:
    """Spearman correlation per key; ranks are taken after incomplete pairs are dropped."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    opts = dict(max_group=max_group, split_rows=split_rows, row_id=row_id)
    pairs = _by_group(pairs, keys, max_group, split_rows)
    ranked = with_ranks(pairs, keys, F.when(both, F.col("x")), average="rx", **opts)
    ranked = with_ranks(ranked, keys, F.when(both, F.col("y")), average="ry", **opts)
    return ranked.groupBy(*keys).agg(pair_corr(F.col("rx"), F.col("ry")).alias("rank_ic"))


def compute_ic(factors: DataFrame, labels: DataFrame, *, validate: bool = True) -> DataFrame:
    """Pearson correlation per date; dates without a usable pair appear with NULL."""
    return ic_of_pairs(align(factors, labels, validate=validate), ["date", "factor", "label"])


def compute_rank_ic(factors: DataFrame, labels: DataFrame, *, max_group: int | None = None, split_rows: int | None = None, validate: bool = True) -> DataFrame:
    return rank_ic_of_pairs(align(factors, labels, validate=validate), ["date", "factor", "label"], max_group=max_group, split_rows=split_rows)


def compute_ic_summary(ic: DataFrame, *, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    v = clean(value_col)
    stats = ic.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n_obs"))
    ir = ratio(F.col("mean"), F.col("std"))
    return stats.select(
        *by, F.lit(value_col).alias("metric"), "mean", "std", ir.alias("ic_ir"),
        (ir * F.sqrt(F.col("n_obs").cast("double"))).alias("t_stat"), "n_obs",
    )


def compute_rolling_ic(ic: DataFrame, *, value_col: str, window: int = 63, min_periods: int = 5) -> DataFrame:
    """Rolling mean over dates, per factor; a factor has one row per date."""
    if window <= 1:
        raise ValueError("window must be > 1")
    frame = W.partitionBy("factor").orderBy("date").rowsBetween(-(window - 1), 0)
    v = clean(value_col)
    return ic.select(
        "date", "factor", gated(F.avg(v).over(frame), F.count(v).over(frame), min_periods).alias(f"rolling_{value_col}")
    )


def coverage_by_date(factors: DataFrame, labels: DataFrame) -> DataFrame:
    """Assets with a factor value, with a label, and with both."""
    f = factors.where(clean("value").isNotNull()).select("date", "asset").distinct().withColumn("__f", F.lit(1))
    y = labels.where(clean("value").isNotNull()).select("date", "asset").distinct().withColumn("__y", F.lit(1))
    counts = f.join(y, ["date", "asset"], "full_outer").groupBy("date").agg(
        F.count("__f").alias("n_factor_assets"),
        F.count("__y").alias("n_label_assets"),
        F.count_if(F.col("__f").isNotNull() & F.col("__y").isNotNull()).alias("n_overlap_assets"),
    )
    return counts.withColumn("coverage_overlap_vs_factor", ratio(F.col("n_overlap_assets"), F.col("n_factor_assets")))


def with_quantile(
    df: DataFrame, value_col: str, n_quantiles: int, *, keys: Sequence[str], max_group: int | None = None,
    split_rows: int | None = None, row_id: Sequence[str] = ("asset",),
) -> DataFrame:
    """Add ``quantile`` from the dense rank, both end buckets pinned, halves rounded up.

    Rows without a value, or in a cross-section of fewer than two values, are removed.
    Integer arithmetic: floor((r-1)/(D-1)*(Q-1) + 1 + 1/2) with Q = min(n_quantiles, n).
    """
    if n_quantiles < 2:
        raise ValueError(f"n_quantiles must be >= 2, got {n_quantiles}")
    ranked = with_ranks(
        df, keys, clean(value_col), dense="__r", size="__n", distinct="__d", row_id=row_id, max_group=max_group, split_rows=split_rows
    ).where("__r is not null and __n >= 2")
    q = f"least({n_quantiles}, __n)"
    bucket = F.expr(f"if(__d = 1, 1, (2 * (__r - 1) * ({q} - 1) + 3 * (__d - 1)) div (2 * greatest(__d - 1, 1)))")
    return ranked.withColumn("quantile", bucket.cast("int")).drop("__r", "__n", "__d")


def quantile_assignments(factors: DataFrame, n_quantiles: int = 5, *, max_group: int | None = None, split_rows: int | None = None) -> DataFrame:
    out = with_quantile(factors, "value", n_quantiles, keys=["date", "factor"], max_group=max_group, split_rows=split_rows)
    return out.select("date", "asset", "factor", "quantile")


def quantile_returns_of_pairs(pairs: DataFrame, n_quantiles: int, keys: Sequence[str], *, max_group: int | None = None, split_rows: int | None = None) -> DataFrame:
    complete = _by_group(pairs, keys, max_group, split_rows).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    out = with_quantile(complete, "x", n_quantiles, keys=keys, max_group=max_group, split_rows=split_rows)
    return out.groupBy(*keys, "quantile").agg(F.avg("y").alias("mean_return"))


def quantile_returns(factors: DataFrame, labels: DataFrame, n_quantiles: int = 5, *, max_group: int | None = None, split_rows: int | None = None, validate: bool = True) -> DataFrame:
    """Mean label per bucket; buckets are assigned on complete pairs only."""
    return quantile_returns_of_pairs(align(factors, labels, validate=validate), n_quantiles, ["date", "factor"], max_group=max_group, split_rows=split_rows)


def long_short_return(quantile_ret: DataFrame, keys: Sequence[str] = ("date", "factor")) -> DataFrame:
    """Top occupied bucket minus bottom occupied bucket."""
    spread = F.max_by("mean_return", "quantile") - F.min_by("mean_return", "quantile")
    return quantile_ret.groupBy(*keys).agg(F.when(F.min("quantile") < F.max("quantile"), spread).alias("long_short_return"))


def quantile_monotonicity(quantile_ret: DataFrame, keys: Sequence[str] = ("date", "factor")) -> DataFrame:
    """Rank correlation of bucket with return, and whether returns never change direction.

    At most ``n_quantiles`` rows per key reach the windows.
    """
    ranked = with_ranks(quantile_ret, keys, F.col("mean_return"), average="__rr", max_group=1_000)
    step = F.col("mean_return") - F.lag("mean_return").over(W.partitionBy(*keys).orderBy("quantile"))
    out = ranked.withColumn("__step", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_quantiles_present"),
        pair_corr(F.col("quantile").cast("double"), F.col("__rr")).alias("rank_corr_quantile_return"),
        F.coalesce(F.bool_and(F.col("__step") >= 0) | F.bool_and(F.col("__step") <= 0), F.lit(False)).alias("is_monotonic"),
    )
    return out


def quantile_turnover(assignments: DataFrame, keys: Sequence[str] = ("factor",)) -> DataFrame:
    """Share of a bucket's members that were not in it on the previous panel date.

    The previous date is that of the whole panel: an asset that skipped it counts as new.
    """
    panel = assignments.select(*keys, "date").distinct().withColumn(
        "__prev", F.lag("date").over(W.partitionBy(*keys).orderBy("date"))
    )
    own = W.partitionBy(*keys, "asset").orderBy("date")
    seen = assignments.withColumns({"__d": F.lag("date").over(own), "__q": F.lag("quantile").over(own)})
    stayed = (F.col("__d") == F.col("__prev")) & (F.col("__q") == F.col("quantile"))
    return attach_small(seen, panel, [*keys, "date"], "inner").groupBy("date", *keys, "quantile").agg(
        F.when(F.max("__prev").isNotNull(), ratio(F.count(F.lit(1)) - F.count_if(stayed), F.count(F.lit(1)))).alias("turnover")
    )


def long_short_turnover(quantile_turn: DataFrame, keys: Sequence[str] = ("factor",)) -> DataFrame:
    mean = (F.min_by("turnover", "quantile") + F.max_by("turnover", "quantile")) / F.lit(2.0)
    return quantile_turn.groupBy("date", *keys).agg(
        F.when(F.min("quantile") < F.max("quantile"), mean).alias("long_short_turnover")
    )


def signal_decay_profile(
    factors: DataFrame, prices: DataFrame, *, horizons: Sequence[int] = DECAY_HORIZONS, max_group: int | None = None
) -> DataFrame:
    """Mean rank correlation with the forward return at several horizons.

    All leads come from one window over the prices, and all horizons from one job.
    """
    if any(h <= 0 for h in horizons):
        raise ValueError("horizons must be positive")
    own = W.partitionBy("asset").orderBy("date")
    ahead = [
        F.struct(F.lit(int(h)).alias("horizon"), (ratio(F.lead("__c", int(h)).over(own), F.col("__c")) - 1).alias("y")) for h in horizons
    ]
    future = prices.select("date", "asset", positive_close().alias("__c")).select("date", "asset", F.array(*ahead).alias("__a"))
    pairs = (
        factors.select("date", "asset", "factor", clean("value").alias("x")).join(future, ["date", "asset"])
        .select("date", "asset", "factor", "x", F.inline("__a"))
    )
    ic = rank_ic_of_pairs(pairs, ["date", "factor", "horizon"], max_group=max_group)
    return ic.groupBy("factor", "horizon").agg(F.avg("rank_ic").alias("mean_rank_ic"), F.count("rank_ic").alias("n_obs"))


def estimate_half_life(decay: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    """ln 2 over the decay rate of a log-linear fit of |IC| on the horizon; NULL if not decaying."""
    size = F.abs(F.col("mean_rank_ic"))
    y = F.when(size > 0, F.ln(size))
    x = F.when(y.isNotNull(), F.col("horizon").cast("double"))
    fitted = decay.groupBy(*by).agg(F.when((F.count(y) >= 2) & (F.min(x) < F.max(x)), -F.regr_slope(y, x)).alias("__l"))
    return fitted.select(*by, F.when(F.col("__l") > 0, F.lit(0.6931471805599453) / F.col("__l")).alias("half_life_periods"))


def apply_linear_cost(df: DataFrame, cost_rate: float, *, return_col: str, turnover_col: str, output_col: str = "adjusted_return") -> DataFrame:
    if cost_rate < 0:
        raise ValueError(f"cost_rate must be >= 0, got {cost_rate}")
    return df.withColumn(output_col, F.col(return_col) - F.lit(float(cost_rate)) * F.col(turnover_col))


def cost_adjusted_long_short(long_short: DataFrame, turnover: DataFrame, cost_rate: float, keys: Sequence[str] = ("date", "factor")) -> DataFrame:
    merged = long_short.join(turnover.withColumnRenamed("long_short_turnover", "turnover"), list(keys))
    out = apply_linear_cost(merged, cost_rate, return_col="long_short_return", turnover_col="turnover")
    return out.select(*keys, "long_short_return", "turnover", "adjusted_return")


def summarise(ic: DataFrame, rank_ic: DataFrame, long_short: DataFrame, turnover: DataFrame, by: Sequence[str] = ("factor",)) -> DataFrame:
    """One row per ``by``: means of the per-date metrics; turnover only on long-short dates."""
    keys = [*by, "date"]
    per_date = (
        ic.select(*keys, "ic").join(rank_ic.select(*keys, "rank_ic"), keys, "full_outer")
        .join(long_short.select(*keys, "long_short_return", F.lit(True).alias("__ls")), keys, "full_outer")
        .join(turnover.select(*keys, "long_short_turnover"), keys, "left")
    )
    ls = F.col("long_short_return")
    return per_date.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"),
        F.avg("rank_ic").alias("mean_rank_ic"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("ic_ir"),
        F.avg(ls).alias("mean_long_short_return"),
        F.avg(F.when(ls.isNotNull(), (ls > 0).cast("double"))).alias("long_short_hit_rate"),
        F.count("ic").alias("n_dates"),
        F.avg(F.when(F.col("__ls"), F.col("long_short_turnover"))).alias("mean_long_short_turnover"),
    )


def summary_of_pairs(factors: DataFrame, pairs: DataFrame, *, n_quantiles: int = 5, max_group: int | None = None) -> DataFrame:
    """``summarise`` of a factor table and its aligned pairs."""
    keys = ["date", "factor", "label"]
    returns = quantile_returns_of_pairs(pairs, n_quantiles, ["date", "factor"], max_group=max_group)
    turnover = long_short_turnover(quantile_turnover(quantile_assignments(factors, n_quantiles, max_group=max_group)))
    return summarise(ic_of_pairs(pairs, keys), rank_ic_of_pairs(pairs, keys, max_group=max_group), long_short_return(returns), turnover)


def build_factor_report(
    prices: DataFrame, factors: DataFrame, *, horizon: int, n_quantiles: int = 5, rolling_window: int = 63,
    decay_horizons: Sequence[int] = DECAY_HORIZONS, max_group: int | None = None,
) -> dict[str, DataFrame]:
    """All evaluation tables of a factor table, as lazy DataFrames over pairs that are written once."""
    from panelyard.operators.labels import forward_return

    labels = materialize(forward_return(prices, horizon=horizon))
    pairs, keys = aligned(factors, labels), ["date", "factor", "label"]
    ic = ic_of_pairs(pairs, keys)
    rank_ic = rank_ic_of_pairs(pairs, keys, max_group=max_group)
    returns = quantile_returns_of_pairs(pairs, n_quantiles, ["date", "factor"], max_group=max_group)
    assigned = quantile_assignments(factors, n_quantiles, max_group=max_group)
    turnover = quantile_turnover(assigned)
    decay = signal_decay_profile(factors, prices, horizons=decay_horizons, max_group=max_group)
    return {
        "ic": ic,
        "rank_ic": rank_ic,
        "ic_summary": compute_ic_summary(ic, value_col="ic", by=("factor",)).unionByName(
            compute_ic_summary(rank_ic, value_col="rank_ic", by=("factor",))
        ),
        "rolling_rank_ic": compute_rolling_ic(rank_ic, value_col="rank_ic", window=rolling_window),
        "coverage": coverage_by_date(factors, labels),
        "quantile_returns": returns,
        "monotonicity": quantile_monotonicity(returns),
        "long_short": long_short_return(returns),
        "quantile_turnover": turnover,
        "long_short_turnover": long_short_turnover(turnover),
        "decay_profile": decay,
        "half_life": estimate_half_life(decay),
    }
