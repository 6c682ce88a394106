"""Per-date regression neutralization on size, beta and industry.

Only moments cross the network: one partial aggregate per (group, industry) holds counts,
means and centered second moments, so a cross-section of any size never meets in one task.
The small coefficient table is then joined back and the residual is a row expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, pair_corr, ratio
from panelyard.functions.groups import attach

BY = ("date",)
_BASE = "__base"
CLOSED_FORM_RIDGE = 1e-8


def _rows(df: DataFrame, value_col: str, size_col: str | None, beta_col: str | None, industry_col: str | None) -> DataFrame:
    """Rows with y, s, b and the industry g (a missing industry is the baseline category)."""
    zero = F.lit(0.0)
    out = df.withColumns(
        {
            "__y": clean(value_col),
            "__s": clean(size_col) if size_col else zero,
            "__b": clean(beta_col) if beta_col else zero,
        }
    )
    if industry_col is None:
        return out.withColumns({"__g": F.lit(_BASE), "__cats": F.struct(F.lit(_BASE).alias("first"), F.lit(1).cast("long").alias("n"))})
    text = F.col(industry_col).cast("string")
    cats = df.select(text.alias("c")).distinct().agg(F.struct(F.min("c").alias("first"), F.count("c").alias("n"))).scalar()
    return out.withColumn("__cats", cats).withColumn("__g", F.coalesce(text, F.col("__cats.first"), F.lit(_BASE)))


def _moments(valid: DataFrame, by: Sequence[str]) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")

    def co(a: str, b: str) -> Column:
        return n * F.covar_pop(a, b)

    return valid.groupBy(*by, "__g").agg(
        n.alias("n"), F.avg("__y").alias("my"), F.avg("__s").alias("ms"), F.avg("__b").alias("mb"),
        co("__s", "__s").alias("ss"), co("__b", "__b").alias("bb"), co("__s", "__b").alias("sb"),
        co("__s", "__y").alias("sy"), co("__b", "__y").alias("by"),
    )


def _closed_form(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Slopes from within-industry moments (partialling the industry means out first).

    An exposure without variation inside industries gets slope 0, and of two collinear
    exposures only the first is used; fitted values are those of the full regression.
    """
    s = moments.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "ss", "bb", "sb", "sy", "by")])
    det = F.col("ss") * F.col("bb") - F.col("sb") * F.col("sb")
    regular = det > F.lit(1e-12) * F.col("ss") * F.col("bb")
    only_s, only_b = F.try_divide(F.col("sy"), F.col("ss")), F.try_divide(F.col("by"), F.col("bb"))
    slope_s = F.when(regular, F.try_divide(F.col("sy") * F.col("bb") - F.col("by") * F.col("sb"), det)).otherwise(F.coalesce(only_s, F.lit(0.0)))
    slope_b = F.when(regular, F.try_divide(F.col("by") * F.col("ss") - F.col("sy") * F.col("sb"), det)).otherwise(
        F.when(F.col("ss") > 0, F.lit(0.0)).otherwise(F.coalesce(only_b, F.lit(0.0)))
    )
    slopes = s.select(*by, F.col("n").alias("n_obs"), slope_s.alias("bs"), slope_b.alias("bbeta"))
    return moments.join(slopes, list(by)).select(
        *by, "__g", "n_obs", "bs", "bbeta", (F.col("my") - F.col("bs") * F.col("ms") - F.col("bbeta") * F.col("mb")).alias("level")
    )


def _ridge_solver(by: Sequence[str], ridge: float, use_size: bool, use_beta: bool):
    """Solve one group's normal equations from its per-industry moment rows (one row per industry)."""

    slopes = [c for c, used in (("s", use_size), ("b", use_beta)) if used]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        effects = pd.get_dummies(pdf["__g"], dtype=float)
        effects = effects.drop(columns=[c for c in effects.columns if c == pdf["first"].iloc[0]])
        # Mean design row of each industry; second moments split into between and within.
        design = np.column_stack([np.ones(len(pdf)), *[pdf[f"m{c}"] for c in slopes], effects.to_numpy()])
        xtx = design.T @ (design * n[:, None])
        xty = design.T @ (n * pdf["my"].to_numpy())
        for i, c in enumerate(slopes, start=1):
            xty[i] += pdf[f"{c}y"].sum()
            for j, e in enumerate(slopes, start=1):
                xtx[i, j] += pdf["".join(sorted((c, e), reverse=True))].sum()
        system = xtx + ridge * np.eye(len(xtx))
        coef = np.linalg.solve(system, xty) if ridge > 0 else np.linalg.lstsq(system, xty, rcond=None)[0]
        slope = dict(zip(slopes, coef[1:], strict=False))
        level = coef[0] + effects.to_numpy() @ coef[1 + len(slopes):]
        return pdf[[*by, "__g"]].assign(n_obs=n.sum(), bs=slope.get("s", 0.0), bbeta=slope.get("b", 0.0), level=level)

    return solve


def neutralize_signal(
    df: DataFrame, *, value_col: str = "value", by: Sequence[str] = BY, size_col: str | None = None, industry_col: str | None = None,
    beta_col: str | None = None, min_obs: int = 20, ridge: float = 1e-8, output_col: str = "value_neutralized", solver: str = "auto",
) -> dict[str, DataFrame]:
    """Residual of the per-group regression, its coefficients and exposure diagnostics.

    ``solver="auto"`` takes the closed form for a ridge up to ``CLOSED_FORM_RIDGE`` (1e-8, far
    below the noise of the data), and for any larger one the penalized normal equations, which
    a grouped map solves over moment rows, never over data rows. Either can be asked for by
    name; the closed form refuses a ridge that it would ignore.
    """
    if min_obs <= 0:
        raise ValueError("min_obs must be > 0")
    if ridge < 0:
        raise ValueError("ridge must be >= 0")
    if not (size_col or industry_col or beta_col):
        raise ValueError("at least one exposure is required for neutralization")
    if solver not in ("auto", "closed_form", "ridge"):
        raise ValueError(f"unknown solver {solver!r}")
    if solver == "auto":
        solver = "closed_form" if ridge <= CLOSED_FORM_RIDGE else "ridge"
    if solver == "closed_form" and ridge > CLOSED_FORM_RIDGE:
        raise ValueError(f"the closed form doesn't apply a ridge above {CLOSED_FORM_RIDGE}")
    rows = _rows(df, value_col, size_col, beta_col, industry_col)
    complete = F.col("__y").isNotNull() & F.col("__s").isNotNull() & F.col("__b").isNotNull()
    moments = _moments(rows.where(complete), by)
    if solver == "closed_form":
        fit = _closed_form(moments, by)
    else:
        first = df.agg(F.min(F.col(industry_col).cast("string"))).scalar() if industry_col else F.lit(_BASE)
        keyed = moments.withColumn("first", F.coalesce(first, F.lit(_BASE)))
        types = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
        schema = ", ".join([f"`{c}` {types[c]}" for c in by] + ["__g string", "n_obs double", "bs double", "bbeta double", "level double"])
        fit = keyed.groupBy(*by).applyInPandas(_ridge_solver(by, ridge, bool(size_col), bool(beta_col)), schema)
    n_exposures = F.lit(int(bool(size_col)) + int(bool(beta_col))) + F.greatest(F.col("__cats.n") - 1, F.lit(0))
    fitted = attach(rows, fit, [*by, "__g"])
    enough = F.col("n_obs") >= F.greatest(F.lit(min_obs), n_exposures + 2)
    resid = F.col("__y") - F.col("level") - F.col("bs") * F.col("__s") - F.col("bbeta") * F.col("__b")
    data = fitted.withColumn(output_col, F.when(complete & enough, resid))
    exposures = {n: c for n, c in (("size_exposure", size_col), ("beta_exposure", beta_col)) if c}
    extra = [c for c in by if c != "date"]
    diagnostics = exposure_diagnostics(
        data, value_before_col=value_col, value_after_col=output_col, exposures=exposures,
        category_col="__g" if industry_col else None, by=by, report_by=extra,
    )
    return {
        "data": data.select(*df.columns, output_col),
        "coefficients": _coefficients(rows, fit, by, bool(size_col), bool(beta_col), bool(industry_col), min_obs),
        "diagnostics": diagnostics,
    }


def _coefficients(rows: DataFrame, fit: DataFrame, by: Sequence[str], size: bool, beta: bool, industry: bool, min_obs: int) -> DataFrame:
    """Long table (by, exposure, coefficient).

    The intercept is the baseline level. Where a group lacks the baseline category, intercept
    and dummies are not separately identified and the least-norm split is reported.
    """
    cats = rows.select("__cats").limit(1).scalar()
    k = F.lit(int(size) + int(beta)) + F.greatest(F.col("__cats.n") - 1, F.lit(0))
    fit = fit.withColumn("__cats", cats).where(F.col("n_obs") >= F.greatest(F.lit(min_obs), k + 2))
    is_base = F.col("__g") == F.coalesce(F.col("__cats.first"), F.lit(_BASE))
    head = fit.groupBy(*by).agg(
        F.coalesce(F.max(F.when(is_base, F.col("level"))), F.sum("level") / (F.count(F.lit(1)) + 1)).alias("intercept"),
        F.max("bs").alias("bs"), F.max("bbeta").alias("bbeta"),
    )
    terms = [F.struct(F.lit("intercept").alias("exposure"), F.col("intercept").alias("coefficient"))]
    if size:
        terms.append(F.struct(F.lit("size_exposure").alias("exposure"), F.col("bs").alias("coefficient")))
    if beta:
        terms.append(F.struct(F.lit("beta_exposure").alias("exposure"), F.col("bbeta").alias("coefficient")))
    out = head.select(*by, F.inline(F.array(*terms)))
    if industry:
        effects = fit.where(~is_base).join(head.select(*by, "intercept"), list(by)).select(
            *by, F.concat(F.lit("industry_"), F.col("__g")).alias("exposure"), (F.col("level") - F.col("intercept")).alias("coefficient")
        )
        out = out.unionByName(effects)
    return out


def neutralize_size(df: DataFrame, *, size_col: str, **options) -> dict[str, DataFrame]:
    return neutralize_signal(df, size_col=size_col, **options)


def neutralize_beta(df: DataFrame, *, beta_col: str, **options) -> dict[str, DataFrame]:
    return neutralize_signal(df, beta_col=beta_col, **options)


def neutralize_industry(df: DataFrame, *, industry_col: str, **options) -> dict[str, DataFrame]:
    return neutralize_signal(df, industry_col=industry_col, **options)


def exposure_diagnostics(
    df: DataFrame, *, value_before_col: str, value_after_col: str, exposures: dict[str, str], category_col: str | None = None,
    by: Sequence[str] = BY, report_by: Sequence[str] = (), min_rows: int = 3,
) -> DataFrame:
    """Mean |correlation| with each exposure before and after, over groups of >= 3 complete rows.

    ``category_col`` adds one 0/1 exposure per category but the first; its correlations come
    from per-category sums, so rows are not multiplied by the number of categories.
    """
    before, after = clean(value_before_col), clean(value_after_col)
    per_group: DataFrame | None = None
    if exposures:
        items = [F.struct(F.lit(n).alias("exposure"), clean(c).alias("x")) for n, c in sorted(exposures.items())]
        long = df.select(*by, before.alias("b"), after.alias("a"), F.inline(F.array(*items))).where("a is not null and b is not null and x is not null")
        per_group = long.groupBy(*by, "exposure").agg(
            pair_corr(F.col("b"), F.col("x"), min_rows).alias("cb"), pair_corr(F.col("a"), F.col("x"), min_rows).alias("ca")
        )
    if category_col is not None:
        rows = df.select(*by, F.col(category_col).cast("string").alias("g"), before.alias("b"), after.alias("a")).where("a is not null and b is not null")
        first = df.agg(F.min(F.col(category_col).cast("string"))).scalar()
        cats = rows.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("nc"), F.avg("b").alias("mb"), F.avg("a").alias("ma"))
        whole = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"), F.avg("b").alias("wb"), F.avg("a").alias("wa"), F.stddev_pop("b").alias("sb"), F.stddev_pop("a").alias("sa"),
            (F.min("b") < F.max("b")).alias("vb"), (F.min("a") < F.max("a")).alias("va"),
        )
        p = F.col("nc") / F.col("n")
        sd = F.sqrt(p * (1 - p))
        usable = (F.col("n") >= min_rows) & (F.col("nc") < F.col("n"))
        dummy = cats.join(whole, list(by)).where(F.col("g") != first).select(
            *by, F.concat(F.lit("industry_"), F.col("g")).alias("exposure"),
            F.when(usable & F.col("vb"), F.try_divide(p * (F.col("mb") - F.col("wb")), sd * F.col("sb"))).alias("cb"),
            F.when(usable & F.col("va"), F.try_divide(p * (F.col("ma") - F.col("wa")), sd * F.col("sa"))).alias("ca"),
        )
        per_group = dummy if per_group is None else per_group.unionByName(dummy)
    out = per_group.groupBy(*report_by, "exposure").agg(
        F.avg(F.abs("cb")).alias("mean_abs_corr_before"), F.avg(F.abs("ca")).alias("mean_abs_corr_after"),
        F.least(F.count("cb"), F.count("ca")).alias("n_dates_used"),
    )
    return out.select(
        *report_by, "exposure", "mean_abs_corr_before", "mean_abs_corr_after",
        (F.col("mean_abs_corr_before") - F.col("mean_abs_corr_after")).alias("corr_reduction"), "n_dates_used",
    )
