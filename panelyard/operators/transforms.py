"""Cross-sectional transforms of a value column.

``by`` defaults to (date, factor), so a table of many factors is transformed in one job.
``by=("date",)`` pools all factors of a date into one cross-section.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, flag
from panelyard.functions.groups import attach, fits, group_quantiles, with_group_stats, with_ranks

BY = ("date", "factor")


def winsorize_series(df: DataFrame, value_col: str = "value", *, lower: float = 0.01, upper: float = 0.99, row_id: Sequence[str] | None = None, max_group: int | None = None) -> DataFrame:
    """Clip a whole column at its quantiles; the bounds are a one-row scalar subquery."""
    bounds = group_quantiles(
        df.withColumn("__all", F.lit(1)), ["__all"], clean(value_col), (lower, upper), ("lo", "hi"), row_id=row_id, max_group=max_group
    ).select(F.struct("lo", "hi")).scalar()
    v = clean(value_col)
    return df.withColumn("__b", bounds).withColumn(
        value_col, F.when(v.isNotNull(), F.greatest(F.least(v, F.col("__b.hi")), F.col("__b.lo")))
    ).drop("__b")


def zscore_series(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Standardize a whole column; a constant column becomes 0."""
    v = clean(value_col)
    stats = df.agg(F.struct(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))).scalar()
    b = F.col("__b")
    flat = b["sd"].isNull() | (b["lo"] == b["hi"])
    return df.withColumn("__b", stats).withColumn(
        value_col, F.when(flat, F.lit(0.0)).otherwise(F.try_divide(v - b["mu"], b["sd"]))
    ).drop("__b")


def winsorize_cross_section(
    df: DataFrame, *, value_col: str = "value", by: Sequence[str] = BY, lower: float = 0.01, upper: float = 0.99,
    min_group_size: int = 3, max_group: int | None = None, row_id: Sequence[str] | None = None,
) -> DataFrame:
    v = clean(value_col)
    size = {"__n": F.count(v)}
    if fits(max_group):
        limits = {"__lo": F.percentile(v, F.lit(lower)), "__hi": F.percentile(v, F.lit(upper))}
        out = with_group_stats(df, by, {**limits, **size}, max_group=max_group)
    else:
        bounds = group_quantiles(df, by, v, (lower, upper), ("__lo", "__hi"), row_id=row_id)
        out = with_group_stats(attach(df, bounds, by), by, size)
    clipped = F.when(v.isNotNull(), F.greatest(F.least(v, F.col("__hi")), F.col("__lo")))
    return out.withColumn(value_col, F.when(F.col("__n") < min_group_size, v).otherwise(clipped)).drop("__lo", "__hi", "__n")


def zscore_cross_section(
    df: DataFrame, *, value_col: str = "value", by: Sequence[str] = BY, min_group_size: int = 3, max_group: int | None = None
) -> DataFrame:
    v = clean(value_col)
    stats = {"__mu": F.avg(v), "__sd": F.stddev_pop(v), "__n": F.count(v), "__lo": F.min(v), "__hi": F.max(v)}
    out = with_group_stats(df, by, stats, max_group=max_group)
    # A constant group is 0 on every row, rows without a value included.
    z = F.when(F.col("__lo") == F.col("__hi"), F.lit(0.0)).otherwise(F.try_divide(v - F.col("__mu"), F.col("__sd")))
    return out.withColumn(value_col, F.when(F.col("__n") >= min_group_size, z)).drop(*stats)


def rank_cross_section(
    df: DataFrame, *, value_col: str = "value", by: Sequence[str] = BY, pct: bool = True, min_group_size: int = 2,
    max_group: int | None = None, split_rows: int | None = None, row_id: Sequence[str] | None = None,
) -> DataFrame:
    out = with_ranks(
        df, by, clean(value_col), average="__r", size="__n", row_id=row_id, max_group=max_group, split_rows=split_rows
    )
    rank = F.try_divide(F.col("__r"), F.col("__n").cast("double")) if pct else F.col("__r").cast("double")
    return out.withColumn(value_col, F.when(F.col("__n") >= min_group_size, rank)).drop("__r", "__n")


def neutralize_by_group(
    df: DataFrame, *, group_col: str, value_col: str = "value", by: Sequence[str] = BY, min_group_size: int = 3, max_group: int | None = None
) -> DataFrame:
    """Demean inside (by, group); rows without a group get NULL."""
    v = clean(value_col)
    out = with_group_stats(df, [*by, group_col], {"__mu": F.avg(v), "__n": F.count(v)}, max_group=max_group)
    keep = F.col(group_col).isNotNull() & (F.col("__n") >= min_group_size)
    return out.withColumn(value_col, F.when(keep, v - F.col("__mu"))).drop("__mu", "__n")


def apply_min_coverage_gate(
    df: DataFrame, *, value_col: str = "value", by: Sequence[str] = BY, min_coverage: float = 0.3, max_group: int | None = None
) -> DataFrame:
    if not 0 < min_coverage <= 1:
        raise ValueError("min_coverage must be in (0, 1]")
    stats = {"__v": F.count(clean(value_col)), "__n": F.count(F.lit(1))}
    out = with_group_stats(df, by, stats, max_group=max_group)
    return out.where(F.col("__v") / F.col("__n") >= F.lit(float(min_coverage))).drop("__v", "__n")


def apply_universe_mask(factors: DataFrame, universe: DataFrame | None = None, tradability: DataFrame | None = None) -> DataFrame:
    """Value kept only where the key is in the universe and tradable; an absent key is neither.

    One table given for both is joined once.
    """
    out, ok = factors, F.lit(True)
    if universe is not None and universe is tradability:
        out = out.join(universe.select("date", "asset", "in_universe", "is_tradable"), ["date", "asset"], "left")
        return out.withColumn("value", F.when(flag("in_universe") & flag("is_tradable"), F.col("value"))).select(*factors.columns)
    for mask, col in ((universe, "in_universe"), (tradability, "is_tradable")):
        if mask is not None:
            out = out.join(mask.select("date", "asset", col), ["date", "asset"], "left")
            ok = ok & flag(col)
    return out.withColumn("value", F.when(ok, F.col("value"))).select(*factors.columns)


def apply_preprocess(
    factors: DataFrame, *, by: Sequence[str] = BY, winsorize: bool = True, lower: float = 0.01, upper: float = 0.99,
    zscore: bool = True, rank: bool = False, min_group_size: int = 3, min_coverage: float | None = None, max_group: int | None = None,
) -> DataFrame:
    """Winsorize, standardize, rank and coverage gate, each optional, in this order."""
    out = factors
    size = dict(by=by, max_group=max_group)
    if winsorize:
        out = winsorize_cross_section(out, lower=lower, upper=upper, min_group_size=min_group_size, **size)
    if zscore:
        out = zscore_cross_section(out, min_group_size=min_group_size, **size)
    if rank:
        out = rank_cross_section(out, pct=True, min_group_size=min_group_size, **size)
    if min_coverage is not None:
        out = apply_min_coverage_gate(out, min_coverage=min_coverage, **size)
    return out
