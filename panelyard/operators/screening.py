"""Factor screening, redundancy and multiple testing.

The number of factors is the number of columns a wide table would have. Per-key arrays of
factor values are bounded by it; rows are never paired across keys.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, pair_corr, ratio
from panelyard.functions.groups import attach, dealt, fits, with_group_stats, with_ranks
from panelyard.functions.storage import materialize, written_rows
from panelyard.operators.evaluation import align, aligned, compute_ic_summary, rank_ic_of_pairs
from panelyard.operators.gram import complete_covariance, correlations, inflation, series_means


def monotonicity_stats(factors: DataFrame, labels: DataFrame, *, n_quantiles: int = 5, max_group: int | None = None, validate: bool = True) -> DataFrame:
    """Pooled mean label of equal-count buckets per factor: rank correlation with the bucket, and spread.

    Buckets cut the row number (ties by asset) of each date at equal steps; dates on which the
    factor is constant take no part. This is not the bucketing of the quantile returns.
    """
    return monotonicity_of_pairs(aligned(factors, labels, validate=validate), n_quantiles=n_quantiles, max_group=max_group)


def monotonicity_of_pairs(pairs: DataFrame, *, n_quantiles: int = 5, max_group: int | None = None) -> DataFrame:
    keys = ["date", "factor"]
    pairs = (dealt(pairs, keys, written_rows(pairs)) if fits(max_group) else pairs).where("x is not null and y is not null")
    order = F.struct(F.col("x"), F.col("asset"))
    ranked = with_ranks(pairs, keys, order, minimum="__k", size="__n", max_group=max_group)
    ranked = with_group_stats(ranked, keys, {"__lo": F.min("x"), "__hi": F.max("x")}, max_group=max_group).where("__lo < __hi")
    q = f"least({n_quantiles}, __n)"
    bucket = F.expr(f"greatest(1, ((__k - 1) * {q} + __n - 2) div (__n - 1))")
    pooled = ranked.groupBy("factor", bucket.alias("q")).agg(F.avg("y").alias("m"))
    ranks = with_ranks(pooled, ["factor"], F.col("m"), average="__r", max_group=1_000)
    return ranks.groupBy("factor").agg(
        pair_corr(F.col("q").cast("double"), F.col("__r")).alias("monotonicity_corr"),
        F.when(F.count(F.lit(1)) >= 2, F.max_by("m", "q") - F.min_by("m", "q")).alias("long_short_spread"),
    )


def univariate_factor_stats(factors: DataFrame, labels: DataFrame, *, n_quantiles: int = 5, max_group: int | None = None, rank_ic: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Coverage, rank IC statistics and pooled monotonicity per factor.

    ``rank_ic`` of the same pairs, if known, isn't taken again, nor are ``pairs``, the written result of ``aligned``.
    """
    pairs = aligned(factors, labels) if pairs is None else pairs
    rank_ic = rank_ic_of_pairs(pairs, ["date", "factor", "label"], max_group=max_group) if rank_ic is None else rank_ic
    coverage = factors.groupBy("factor").agg(F.avg(clean("value").isNotNull().cast("double")).alias("coverage"))
    ic = compute_ic_summary(rank_ic, value_col="rank_ic", by=("factor",)).select(
        "factor", F.col("mean").alias("rank_ic_mean"), F.col("std").alias("rank_ic_std"), F.col("ic_ir").alias("rank_ic_ir"),
        F.col("t_stat").alias("rank_ic_t_stat"),
    )
    mono = monotonicity_of_pairs(pairs, n_quantiles=n_quantiles, max_group=max_group)
    out = coverage.join(ic, "factor", "left").join(mono, "factor", "left")
    return out.select(
        "factor", "coverage", "rank_ic_mean", "rank_ic_std", "rank_ic_ir", "rank_ic_t_stat", "monotonicity_corr",
        F.abs("monotonicity_corr").alias("abs_monotonicity"), "long_short_spread",
    )


def pairwise_correlation(values: DataFrame, keys: Sequence[str] = ("date", "asset"), name: str = "factor") -> DataFrame:
    """Pairwise-complete correlation of every two series of a long table: a, b, corr.

    Moments come from masked products of dense blocks (``gram``). Pairs without a common key appear with NULL; a key with
    two values of one series raises.
    """
    found = correlations(values, keys, name)
    names = series_names(values, name)
    every = names.select(F.explode(F.transform("names", lambda n, i: F.struct(n.alias("a"), F.slice("names", i + 2, F.greatest(F.size("names") - i - 1, F.lit(0))).alias("r")))).alias("p"))
    every = every.select(F.col("p.a").alias("a"), F.explode("p.r").alias("b"))
    return every.join(found, ["a", "b"], "left")


def series_names(values: DataFrame, name: str = "factor") -> DataFrame:
    """One row: the sorted distinct names and their number."""
    return values.select(F.col(name).cast("string").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("names"))


def pairwise_redundancy(factors: DataFrame) -> dict[str, DataFrame]:
    """Pair table and the largest absolute correlation per factor."""
    pairs = pairwise_correlation(factors).select(F.col("a").alias("factor_a"), F.col("b").alias("factor_b"), "corr")
    ends = pairs.select(F.explode(F.array("factor_a", "factor_b")).alias("factor"), F.abs("corr").alias("c"))
    return {"pairs": pairs, "max_abs_corr": ends.groupBy("factor").agg(F.max("c").alias("max_abs_corr"))}


#: factors whose covariance matrix may go to the driver for inflation factors
MAX_FACTORS = 2_000


def vif_diagnostics(factors: DataFrame) -> DataFrame:
    """Variance inflation per factor over complete keys: all diagonals of the inverse correlation matrix at once.

    More than ``MAX_FACTORS`` factors raise before their moments are collected.
    """
    names, cov, varies, n = complete_covariance(factors, ("date", "asset"), "factor", MAX_FACTORS)
    if len(names) == 1:
        values = [1.0]
    elif n < len(names) + 1:
        values = [None] * len(names)
    else:
        values = [None if np.isnan(v) else float(v) for v in inflation(cov, varies)]
    return factors.sparkSession.createDataFrame(list(zip(names, values, strict=True)), "factor string, vif double")


def marginal_ic_contribution(factors: DataFrame, labels: DataFrame, *, max_group: int | None = None) -> DataFrame:
    """Rank IC of the equal-weight pool with and without each factor.

    The pool is a mean of per-date z-scores; leaving one factor out subtracts its own term. On a date where a factor does
    not vary its z-score is 0 for every asset of that date, whether the asset has a row or not. ``max_group`` is a measured
    bound of assets per date: if it fits a task, all k + 1 pools of a date are columns of one array and are ranked there,
    so factors and labels move once, by date. Otherwise pools are ranked as factors of their own, split by value ranges.
    A single factor has no pool without it: NULL.
    """
    names = [n for n, _ in series_means(factors, "factor")]
    if fits(max_group) and max_group * (len(names) + 1) <= ARRAY_CELLS:
        ic = _pool_ic_by_date(factors, labels, names)
    else:
        ic = _pool_ic_by_ranges(factors, labels, max_group)
    means = ic.groupBy("factor").agg(F.avg("rank_ic").alias("m"))
    full = means.where(F.col("factor") == _FULL).select("m").scalar()
    if len(names) < 2:
        return factors.sparkSession.createDataFrame([(n, None, None, None) for n in names], "factor string, pool_rank_ic_full double, pool_rank_ic_without_factor double, marginal_delta double")
    out = means.where(F.col("factor") != _FULL).withColumn("pool_rank_ic_full", full)
    return out.select(
        "factor", "pool_rank_ic_full", F.col("m").alias("pool_rank_ic_without_factor"),
        (F.col("pool_rank_ic_full") - F.col("m")).alias("marginal_delta"),
    )


#: name of the pool of all factors, and cells (assets x pools) of a date that one task may hold
_FULL, ARRAY_CELLS = "\u0000full", 20_000_000


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks of each column of an array without missing values."""
    order = np.argsort(x, axis=0, kind="stable")
    out = np.empty(x.shape)
    for c in range(x.shape[1]):
        v = x[order[:, c], c]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        size = np.diff(np.append(first, len(v)))
        out[order[:, c], c] = np.repeat(first + (size + 1) / 2, size)
    return out


def _pools(x: np.ndarray) -> np.ndarray:
    """The full pool and the k pools without one factor, as columns, of values (assets, k) of one date; NaN is missing."""
    k = x.shape[1]
    with np.errstate(invalid="ignore", divide="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # columns without a value
        varies = np.nanmin(x, axis=0, initial=np.inf) < np.nanmax(x, axis=0, initial=-np.inf)
        z = np.where(varies, (x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0), 0.0)
        there = np.isfinite(z)
        z = np.where(there, z, 0.0)
        total, count = z.sum(1, keepdims=True), there.sum(1, keepdims=True)
        sums = np.concatenate([total, total - z], axis=1)
        counts = np.concatenate([count, count - there], axis=1)
        return sums / np.where(counts > 0, counts, np.nan) if k else sums


def _pool_ic_by_date(factors: DataFrame, labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """(date, factor: the pool's missing factor, rank_ic): one task a date, which holds all pools of its assets."""
    at = {n: i for i, n in enumerate(names)}
    pools = [_FULL, *names]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        assets = left.column("asset").combine_chunks().dictionary_encode()
        row = assets.indices.to_numpy(zero_copy_only=False)
        column = np.array([at[n] for n in left.column("factor").to_pylist()])
        x = np.full((len(assets.dictionary), len(names)), np.nan)
        x[row, column] = left.column("v").to_numpy(zero_copy_only=False)
        pool = _pools(x)
        number = {a: i for i, a in enumerate(assets.dictionary.to_pylist())}
        own = np.array([number.get(a, -1) for a in right.column("asset").to_pylist()], np.int64)
        y = right.column("y").to_numpy(zero_copy_only=False)[own >= 0]
        found = _all_rank_correlations(pool[own[own >= 0]], y)  # a row for each pair of an asset and a label
        n = len(pools) if len(y) else 0
        return pa.table({"date": pa.array([key[0].as_py()] * n, pa.date32()), "factor": pa.array(pools[:n], pa.string()), "rank_ic": pa.array(found[:n], pa.float64())})

    left = factors.select("date", F.col("asset").cast("string").alias("asset"), F.col("factor").cast("string").alias("factor"), clean("value").alias("v"))
    right = labels.select("date", F.col("asset").cast("string").alias("asset"), clean("value").alias("y"))
    return left.groupBy("date").cogroup(right.groupBy("date")).applyInArrow(run, "date date, factor string, rank_ic double")


def _all_rank_correlations(pools: np.ndarray, y: np.ndarray) -> list[float | None]:
    """Rank correlation of every column with the label; columns that miss the same rows are ranked together."""
    there = np.isfinite(pools) & np.isfinite(y)[:, None]
    out: list[float | None] = [None] * pools.shape[1]
    masks, of = np.unique(there, axis=1, return_inverse=True)
    for m in range(masks.shape[1]):
        keep, columns = masks[:, m], np.flatnonzero(of.ravel() == m)
        if keep.sum() < 2:
            continue
        r = _average_ranks(np.column_stack([y[keep], pools[np.ix_(keep, columns)]]))
        r -= r.mean(0)
        norm = (r * r).sum(0)
        for c, s, v in zip(columns.tolist(), r[:, 0] @ r[:, 1:], norm[1:], strict=True):
            if v > 0 and norm[0] > 0:
                out[c] = float(s / np.sqrt(v * norm[0]))
    return out


def _pool_ic_by_ranges(factors: DataFrame, labels: DataFrame, max_group: int | None) -> DataFrame:
    """As ``_pool_ic_by_date`` for dates that no task may hold: pools are factors of a long table."""
    keys = ["date", "factor"]
    v = clean("value")
    stats = factors.groupBy(*keys).agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sd"), (F.min(v) < F.max(v)).alias("varies"))
    regular = stats.where("varies")
    per_date = regular.groupBy("date").agg(F.collect_set("factor").alias("__reg"))
    z = factors.select(*keys, "asset", v.alias("v")).join(regular.select(*keys, "mu", "sd"), keys, "left")
    z = z.withColumn("z", F.try_divide(F.col("v") - F.col("mu"), F.col("sd")))
    pool = z.groupBy("date", "asset").agg(
        F.coalesce(F.sum("z"), F.lit(0.0)).alias("s"), F.count("z").alias("p"),
        F.map_from_entries(F.collect_list(F.when(F.col("z").isNotNull(), F.struct("factor", "z")))).alias("own"),
    )
    pool = attach(pool, per_date, ["date"]).withColumn("names", series_names(factors).scalar())
    k = F.size("names")
    flat = k - F.coalesce(F.size("__reg"), F.lit(0))
    pool = pool.withColumn("flat", flat)
    out_of = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("names")))
    rows = pool.withColumn("out", out_of)
    is_regular = F.coalesce(F.array_contains(F.coalesce("__reg", F.array().cast("array<string>")), F.col("out")), F.lit(False))
    own = F.try_element_at("own", F.coalesce("out", F.lit("")))
    total = F.col("s") - F.when(F.col("out").isNotNull() & is_regular, F.coalesce(own, F.lit(0.0))).otherwise(F.lit(0.0))
    gone = F.when(F.col("out").isNull(), 0).when(is_regular, own.isNotNull().cast("int")).otherwise(1)
    n = F.col("p") + F.col("flat") - gone
    composite = rows.select("date", "asset", F.coalesce("out", F.lit(_FULL)).alias("factor"), ratio(total, n).alias("value"))
    return rank_ic_of_pairs(align(composite, labels, validate=False), ["date", "factor"], max_group=max_group)


def decide(merged: DataFrame, *, min_coverage: float, min_abs_monotonicity: float, max_pairwise_corr: float, max_vif: float) -> DataFrame:
    """Gate columns and the screening decision of a table of factor statistics."""
    out = merged.withColumns(
        {"max_abs_corr": F.coalesce("max_abs_corr", F.lit(0.0)), "vif": F.coalesce("vif", F.lit(1.0))}
    ).withColumns(
        {
            "coverage_pass": F.coalesce(F.col("coverage") >= min_coverage, F.lit(False)),
            "monotonicity_pass": F.coalesce(F.col("abs_monotonicity") >= min_abs_monotonicity, F.lit(False)),
            "redundancy_pass": (F.col("max_abs_corr") <= max_pairwise_corr) & (F.col("vif") <= max_vif),
        }
    )
    unknown = F.col("rank_ic_mean").isNull() | F.col("abs_monotonicity").isNull()
    weak = ~F.col("coverage_pass") | ~F.col("monotonicity_pass")

    def choose(a: str, b: str, c: str, e: str) -> Column:
        return F.when(unknown, a).when(weak, b).when(~F.col("redundancy_pass"), c).otherwise(e)

    return out.withColumns(
        {
            "decision": choose("needs_review", "weak_factor", "redundant_factor", "candidate_factor"),
            "decision_reason": choose(
                "missing_ic_or_monotonicity", "coverage_or_monotonicity_gate_failed", "correlation_or_vif_gate_failed", "all_primary_gates_passed"
            ),
        }
    )


def screen_factors(
    factors: DataFrame, labels: DataFrame, *, n_quantiles: int = 5, min_coverage: float = 0.6, min_abs_monotonicity: float = 0.1,
    max_pairwise_corr: float = 0.9, max_vif: float = 10.0, max_group: int | None = None, rank_ic: DataFrame | None = None, pairs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Statistics, redundancy, inflation, decisions and marginal contributions; ``rank_ic`` and ``pairs`` as in ``univariate_factor_stats``."""
    if not 0 < min_coverage <= 1 or not 0 <= min_abs_monotonicity <= 1 or not 0 < max_pairwise_corr <= 1 or max_vif <= 1:
        raise ValueError("screening thresholds are out of range")
    summary = univariate_factor_stats(factors, labels, n_quantiles=n_quantiles, max_group=max_group, rank_ic=rank_ic, pairs=pairs)
    redundancy, vif = pairwise_redundancy(factors), vif_diagnostics(factors)
    merged = summary.join(redundancy["max_abs_corr"], "factor", "left").join(vif, "factor", "left")
    decisions = decide(
        merged, min_coverage=min_coverage, min_abs_monotonicity=min_abs_monotonicity, max_pairwise_corr=max_pairwise_corr, max_vif=max_vif
    )
    return {
        "summary": summary,
        "decisions": decisions,
        "pairwise_correlation": redundancy["pairs"],
        "vif": vif,
        "marginal_contribution": marginal_ic_contribution(factors, labels, max_group=max_group),
    }


def select_signals(candidate: DataFrame, decisions: DataFrame) -> DataFrame:
    """Signals of the candidate factors; with fewer than two of them, of the best two by rank IC and coverage."""
    decisions = materialize(decisions.select("factor", "decision", "rank_ic_mean", "coverage"))
    n = decisions.agg(F.count_if(F.col("decision") == "candidate_factor")).scalar()
    best = F.struct(F.coalesce("rank_ic_mean", F.lit(float("-inf"))).alias("ic"), F.coalesce("coverage", F.lit(float("-inf"))).alias("c"))
    order = F.struct((-best["ic"]).alias("ic"), (-best["c"]).alias("c"), F.col("factor"))
    if decisions.limit(2).count() < 2:
        raise ValueError("fewer than two factors to choose from")
    # One row per factor.
    ranked = with_ranks(decisions.withColumn("__all", F.lit(1)), ["__all"], order, minimum="__k", max_group=100_000)
    chosen = ranked.withColumn("__n", n).where(
        F.when(F.col("__n") >= 2, F.col("decision") == "candidate_factor").otherwise(F.col("__k") <= 2)
    )
    return candidate.join(chosen.select("factor"), "factor", "left_semi").select(*candidate.columns)


def bonferroni_threshold(alpha: float, n_tests: float) -> float:
    _check_alpha(alpha, n_tests)
    return alpha / n_tests


def sidak_threshold(alpha: float, n_tests: float) -> float:
    _check_alpha(alpha, n_tests)
    return 1.0 - (1.0 - alpha) ** (1.0 / n_tests)


def _check_alpha(alpha: float, n_tests: float) -> None:
    if not 0 < alpha < 1:
        raise ValueError("alpha must be in (0, 1)")
    if n_tests <= 0:
        raise ValueError("n_tests must be > 0")


def adjust_pvalues(
    df: DataFrame, *, pvalue_col: str = "p_value", alpha: float = 0.05, method: str = "bonferroni", n_tests: float | None = None
) -> DataFrame:
    """Add the adjusted p-value, the adjusted level and the rejection of every test in the table."""
    kind = method.lower()
    if kind not in ("bonferroni", "sidak"):
        raise ValueError("method must be 'bonferroni' or 'sidak'")
    _check_alpha(alpha, 1.0 if n_tests is None else n_tests)
    count = df.agg(F.count(F.lit(1)).cast("double")).scalar() if n_tests is None else F.lit(float(n_tests))
    out = df.withColumns({"mt_method": F.lit(kind), "mt_alpha": F.lit(float(alpha)), "mt_n_tests": count})
    p, n, one = F.col(pvalue_col).cast("double"), F.col("mt_n_tests"), F.lit(1.0)
    if kind == "bonferroni":
        level, adjusted = F.try_divide(F.lit(float(alpha)), n), p * n
    else:
        level, adjusted = one - F.pow(one - F.lit(float(alpha)), F.try_divide(one, n)), one - F.pow(one - p, n)
    out = out.withColumns({"mt_adjusted_alpha": level, "mt_adjusted_pvalue": F.least(adjusted, one)})
    return out.withColumn("mt_reject", F.col("mt_adjusted_pvalue") <= F.lit(float(alpha)))


apply_multiple_testing_to_trial_log = adjust_pvalues


#: series whose correlation matrix may go to the driver (at most MAX_SERIES^2 / 2 pairs)
MAX_SERIES = 1_000


def effective_count(
    pairs: DataFrame, corr_col: str = "corr", name_cols: tuple[str, str] = ("a", "b"), names: Sequence[str] | None = None
) -> DataFrame:
    """One row: series, mean |correlation|, and effective number of independent series.

    (sum of eigenvalues)^2 / sum of squared eigenvalues of the correlation matrix, negative ones
    set to 0: pairwise-complete correlations need not make a proper matrix. The k x k matrix is
    solved on the driver, so k is bounded by ``MAX_SERIES``. ``names`` adds series without a
    pair. A missing or repeated correlation raises.
    """
    a, b = name_cols
    rows = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(corr_col).cast("double").alias("r")).limit(MAX_SERIES * (MAX_SERIES - 1) // 2 + 1).collect()
    found = sorted({r["a"] for r in rows} | {r["b"] for r in rows} | set(names or ()))
    k = len(found)
    if k > MAX_SERIES:
        raise ValueError(f"more than {MAX_SERIES} series")
    if any(r["r"] is None or np.isnan(r["r"]) for r in rows):
        raise ValueError("correlations must not be missing")
    if len(rows) != k * (k - 1) // 2:
        raise ValueError(f"{k} series need {k * (k - 1) // 2} pairs, got {len(rows)}")
    at = {n: i for i, n in enumerate(found)}
    matrix = np.eye(k)
    for r in rows:
        matrix[at[r["a"]], at[r["b"]]] = matrix[at[r["b"]], at[r["a"]]] = r["r"]
    values = np.clip(np.linalg.eigvalsh(matrix), 0.0, None) if k else np.zeros(0)
    effective = float(np.clip(values.sum() ** 2 / (values**2).sum(), 1.0, k)) if k else None
    mean = float(np.mean([abs(r["r"]) for r in rows])) if rows else None
    return pairs.sparkSession.createDataFrame([(k, mean, effective)], "n long, avg_abs_corr double, effective_n double")


def effective_trial_count(pairs: DataFrame, **columns) -> DataFrame:
    return effective_count(pairs, **columns).select(F.col("n").alias("n_trials"), F.col("effective_n").alias("effective_trial_count"))


def student_t_two_sided():
    """Pandas UDF (t, df) -> two-sided Student-t tail, for tables of a few result rows.

    The density is proportional to cos(theta)^(df - 1) after t = sqrt(df) tan(theta), so the tail
    is a ratio of two smooth integrals, done by Gauss-Legendre quadrature.
    """

    def tail(t: pd.Series, df: pd.Series) -> pd.Series:
        nodes, weights = np.polynomial.legendre.leggauss(400)

        def area(lo: float, hi: float, power: float) -> float:
            theta = 0.5 * (hi - lo) * nodes + 0.5 * (hi + lo)
            return 0.5 * (hi - lo) * float(weights @ np.cos(theta) ** power)

        out = []
        for ti, di in zip(t.to_numpy(dtype=float), df.to_numpy(dtype=float), strict=True):
            if not (np.isfinite(ti) and di > 0):
                out.append(None)
                continue
            edge, end = float(np.arctan(abs(ti) / np.sqrt(di))), np.pi / 2
            # The mass near zero has width 1 / sqrt(df): split the ranges there.
            knee = min(6.0 / np.sqrt(di + 1.0), end)
            whole = area(0.0, knee, di - 1.0) + area(knee, end, di - 1.0)
            far = area(edge, end, di - 1.0) if edge >= knee else area(edge, knee, di - 1.0) + area(knee, end, di - 1.0)
            out.append(min(1.0, far / whole))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(tail, "double")


def ic_pvalues(ic_summary: DataFrame, *, trial_count: int = 1) -> DataFrame:
    """Two-sided p-value of the rank-IC t-statistic and its Bonferroni adjustment, one row per factor."""
    rows = ic_summary.where(F.col("metric") == "rank_ic")
    ok = F.col("t_stat").isNotNull() & (F.col("n_obs") > 1)
    p = F.when(ok, student_t_two_sided()(F.col("t_stat"), (F.col("n_obs") - 1).cast("double")))
    keys = [c for c in ("factor",) if c in rows.columns]
    return rows.select(*keys, "t_stat", "n_obs", p.alias("p_value")).withColumn(
        "adjusted_p_value", F.least(F.col("p_value") * F.lit(float(trial_count)), F.lit(1.0))
    )
