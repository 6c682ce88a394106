"""Screening, multiple testing, composite signals, alpha pool and feature importance."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from panelyard.catalog.evaluation import _R, pair_ctes
from panelyard.catalog.panels import assets_per_date, avg_rank_sql, corr_sql, cte, fwd1, low_vol_sql, momentum_sql, px, signals, sql_with, stored_signals
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.functions.groups import dealt
from panelyard.functions.storage import materialize, written_rows
from panelyard.operators import composite as cp
from panelyard.operators import evaluation as ev
from panelyard.operators import importance as imp
from panelyard.operators import screening as sc
from panelyard.operators.factors import low_volatility, momentum, reversal
from panelyard.operators.labels import forward_return

# Six factors, two of them the same up to sign, for redundancy and clusters.
_POOL = [
    ("mom2", momentum_sql("px", 2), lambda p: momentum(p, window=2)),
    ("mom3x", momentum_sql("px", 3), lambda p: momentum(p, window=3)),
    ("mom6", momentum_sql("px", 6), lambda p: momentum(p, window=6)),
    ("rev3", momentum_sql("px", 3, "-", "reversal_3d"), lambda p: reversal(p, window=3)),
    ("lv4x", low_vol_sql("px", 4), lambda p: low_volatility(p, window=4)),
    ("lv8", low_vol_sql("px", 8), lambda p: low_volatility(p, window=8)),
]
for _name, _sql, _fn in _POOL:
    cte(_name, "px", _sql)
cte("pool", " ".join(n for n, _, _ in _POOL), " UNION ALL ".join(f"SELECT * FROM {n}" for n, _, _ in _POOL))
pair_ctes("pool", "pool", "fwd1")


def _pool_of(prices):
    out = None
    for _, _, fn in _POOL:
        out = fn(prices) if out is None else out.unionByName(fn(prices))
    # Screening reads the pool several times.
    return materialize(out)


def _pool_prices(spark, d):
    prices = materialize(px(spark, d))
    return dealt(prices, ["asset"], written_rows(prices))


def pool(spark, d):
    return _pool_of(_pool_prices(spark, d))


def pool_and_label(spark, d):
    """The pool and the next return, both written, of prices that are taken from the lines once."""
    prices = _pool_prices(spark, d)
    return _pool_of(prices), materialize(forward_return(prices, horizon=1))


def mono_ctes(prefix: str, source: str, n: int = 5) -> None:
    cte(
        f"{prefix}_fq", f"{prefix}_pairs",
        f"""SELECT factor, q, avg(y) AS m FROM (SELECT factor, y, greatest(1, ((k - 1) * least({n}, n) + n - 2) // (n - 1)) AS q FROM (
        SELECT *, row_number() OVER (PARTITION BY date, factor ORDER BY x, asset) AS k, count(*) OVER g AS n, min(x) OVER g AS lo, max(x) OVER g AS hi FROM {prefix}_pairs
        WHERE x IS NOT NULL AND y IS NOT NULL WINDOW g AS (PARTITION BY date, factor)) WHERE lo < hi) GROUP BY 1, 2""",
    )
    cte(
        f"{prefix}_mono", f"{prefix}_fq",
        f"""SELECT factor, {corr_sql('qd', 'r')} AS monotonicity_corr, CASE WHEN count(*) >= 2 THEN arg_max(m, q) - arg_min(m, q) END AS long_short_spread FROM (
        SELECT factor, q, m, cast(q as double) AS qd, {avg_rank_sql('factor', 'm')} AS r FROM {prefix}_fq) GROUP BY factor""",
    )
    cte(
        f"{prefix}_uni", f"{source} {prefix}_ic {prefix}_mono",
        f"""SELECT c.factor, coverage, mean AS rank_ic_mean, std AS rank_ic_std, mean / std AS rank_ic_ir, mean / std * sqrt(cast(n as double)) AS rank_ic_t_stat, monotonicity_corr,
        abs(monotonicity_corr) AS abs_monotonicity, long_short_spread FROM (SELECT factor, avg(cast(value IS NOT NULL as double)) AS coverage FROM {source} GROUP BY 1) c
        JOIN (SELECT factor, avg(rank_ic) AS mean, nullif(stddev_samp(rank_ic), 0) AS std, count(rank_ic) AS n FROM {prefix}_ic GROUP BY 1) i ON c.factor = i.factor LEFT JOIN {prefix}_mono m ON m.factor = c.factor""",
    )


mono_ctes("pool", "pool")
mono_ctes("sig", "signals")
_UNI = """round(coverage, 8) AS coverage, round(rank_ic_mean, 7) AS rank_ic_mean, round(rank_ic_std, 7) AS rank_ic_std, round(rank_ic_ir, 6) AS rank_ic_ir, round(rank_ic_t_stat, 5) AS rank_ic_t_stat,
 round(monotonicity_corr, 8) AS monotonicity_corr, round(abs_monotonicity, 8) AS abs_monotonicity, round(long_short_spread, 8) AS long_short_spread"""
_UNI_DIGITS = dict(rank_ic_mean=7, rank_ic_std=7, rank_ic_ir=6, rank_ic_t_stat=5)


@query("pooled_monotonicity", sql_with("pool_mono", "SELECT factor, round(monotonicity_corr, 8) AS monotonicity_corr, round(long_short_spread, 8) AS long_short_spread FROM pool_mono"))
def _(spark, d):
    return rounded(sc.monotonicity_stats(*pool_and_label(spark, d), max_group=assets_per_date(spark, d)))


@query("univariate_factor_stats", sql_with("pool_uni", f"SELECT factor, {_UNI} FROM pool_uni"))
def _(spark, d):
    return rounded(sc.univariate_factor_stats(*pool_and_label(spark, d), max_group=assets_per_date(spark, d)), 8, **_UNI_DIGITS)


def corr_ctes(prefix: str, source: str) -> None:
    """<prefix>_corr (a, b, corr) of all pairs of factors, and <prefix>_max (factor, max_abs_corr)."""
    cte(
        f"{prefix}_corr", source,
        f"""SELECT n.a, n.b, corr FROM (SELECT x.factor AS a, y.factor AS b FROM (SELECT DISTINCT factor FROM {source}) x JOIN (SELECT DISTINCT factor FROM {source}) y ON x.factor < y.factor) n LEFT JOIN (
        SELECT p.factor AS a, q.factor AS b, {corr_sql('p.value', 'q.value')} AS corr FROM {source} p JOIN {source} q ON p.date = q.date AND p.asset = q.asset AND p.factor < q.factor
        WHERE p.value IS NOT NULL AND q.value IS NOT NULL GROUP BY 1, 2) c ON n.a = c.a AND n.b = c.b""",
    )
    cte(f"{prefix}_max", f"{prefix}_corr", f"SELECT factor, max(abs(corr)) AS max_abs_corr FROM (SELECT a AS factor, corr FROM {prefix}_corr UNION ALL SELECT b, corr FROM {prefix}_corr) GROUP BY 1")


corr_ctes("pool", "pool")


@query("pairwise_redundancy", sql_with("pool_corr", "SELECT a AS factor_a, b AS factor_b, round(corr, 7) AS corr FROM pool_corr"))
def _(spark, d):
    return rounded(sc.pairwise_redundancy(pool(spark, d))["pairs"], 7)


@query("max_pairwise_correlation", sql_with("pool_max", "SELECT factor, round(max_abs_corr, 7) AS max_abs_corr FROM pool_max"))
def _(spark, d):
    return rounded(sc.pairwise_redundancy(pool(spark, d))["max_abs_corr"], 7)


@query(
    "variance_inflation",
    sql_with(
        "rev2 lv4",
        """, c AS (SELECT corr(r.value, l.value) AS c FROM rev2 r JOIN lv4 l ON r.date = l.date AND r.asset = l.asset WHERE r.value IS NOT NULL AND l.value IS NOT NULL)
        SELECT factor, round(1 / (1 - c * c), 7) AS vif FROM c, (SELECT unnest(['low_volatility_4d', 'reversal_2d']) AS factor)""",
    ),
)
def _(spark, d):
    prices = px(spark, d)
    return rounded(sc.vif_diagnostics(reversal(prices, window=2).unionByName(low_volatility(prices, window=4))), 7)


def inflation_ctes(prefix: str, source: str, wanted: str, k: int) -> None:
    """Diagonal of the inverse correlation matrix over complete keys, as <prefix>_vif (factor, vif): one sweep a factor."""
    cte(
        f"{prefix}_full", source,
        f"""SELECT date, asset, factor, value FROM ({wanted}) WHERE value IS NOT NULL QUALIFY count(*) OVER (PARTITION BY date, asset) = {k}""",
    )
    cte(f"{prefix}_no", f"{prefix}_full", f"SELECT factor, row_number() OVER (ORDER BY factor) AS i FROM (SELECT DISTINCT factor FROM {prefix}_full)")
    cte(
        f"{prefix}_s0", f"{prefix}_full {prefix}_no",
        f"""SELECT m.i, n.i AS j, corr(p.value, q.value) AS v FROM {prefix}_full p JOIN {prefix}_full q ON p.date = q.date AND p.asset = q.asset
        JOIN {prefix}_no m ON m.factor = p.factor JOIN {prefix}_no n ON n.factor = q.factor GROUP BY 1, 2""",
    )
    for t in range(1, k + 1):
        last = f"{prefix}_s{t - 1}"
        cte(
            f"{prefix}_s{t}", last,
            f"""SELECT a.i, a.j, CASE WHEN a.i = {t} AND a.j = {t} THEN -1 / d.v WHEN a.i = {t} OR a.j = {t} THEN a.v / d.v ELSE a.v - r.v * c.v / d.v END AS v
            FROM {last} a JOIN {last} d ON d.i = {t} AND d.j = {t} JOIN {last} r ON r.i = a.i AND r.j = {t} JOIN {last} c ON c.i = {t} AND c.j = a.j""",
        )
    cte(f"{prefix}_vif", f"{prefix}_s{k} {prefix}_no", f"SELECT factor, -v AS vif FROM {prefix}_s{k} s JOIN {prefix}_no n ON s.i = n.i AND s.j = n.i")


inflation_ctes("many", "signals mom6", "SELECT * FROM signals UNION ALL SELECT * FROM mom6", 4)
inflation_ctes("three", "signals", "SELECT * FROM signals", 3)


@query("variance_inflation_three_factors", sql_with("three_vif", "SELECT factor, round(vif, 6) AS vif FROM three_vif"))
def _(spark, d):
    return rounded(sc.vif_diagnostics(stored_signals(spark, d)), 6)


@query("variance_inflation_many_factors", sql_with("many_vif", "SELECT factor, round(vif, 5) AS vif FROM many_vif"))
def _(spark, d):
    return rounded(sc.vif_diagnostics(stored_signals(spark, d).unionByName(momentum(px(spark, d), window=6))), 5)


cte("mz", "signals", "SELECT *, min(value) OVER w < max(value) OVER w AS ok, CASE WHEN min(value) OVER w < max(value) OVER w THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END AS z FROM signals WINDOW w AS (PARTITION BY date, factor)")
cte("mreg", "mz", "SELECT date, factor FROM mz GROUP BY 1, 2 HAVING bool_or(ok)")
cte(
    "mpool", "mz mreg",
    """SELECT g.date, g.asset, o.out, sum(z) FILTER (f.factor IS DISTINCT FROM o.out) AS s, count(z) FILTER (f.factor IS DISTINCT FROM o.out) AS p,
    any_value(fl.flat) - CASE WHEN o.out IS NOT NULL AND any_value(r.factor) IS NULL THEN 1 ELSE 0 END AS flat
    FROM (SELECT DISTINCT date, asset FROM mz) g CROSS JOIN (SELECT DISTINCT factor AS out FROM mz UNION ALL SELECT NULL) o
    LEFT JOIN mz f ON f.date = g.date AND f.asset = g.asset LEFT JOIN mreg r ON r.date = g.date AND r.factor = o.out
    LEFT JOIN (SELECT d.date, (SELECT count(DISTINCT factor) FROM mz) - count(m.factor) AS flat FROM (SELECT DISTINCT date FROM mz) d LEFT JOIN mreg m ON m.date = d.date GROUP BY 1) fl ON fl.date = g.date
    GROUP BY 1, 2, 3""",
)
cte("mcomp", "mpool", "SELECT date, asset, coalesce(out, '*full') AS factor, coalesce(s, 0) / nullif(cast(p + flat as double), 0) AS value FROM mpool")
pair_ctes("mc", "mcomp", "fwd1")
cte("mcm", "mc_ic", "SELECT factor, avg(rank_ic) AS m FROM mc_ic GROUP BY 1")


@query(
    "marginal_ic_contribution",
    sql_with(
        "mcm",
        """SELECT w.factor, round(f.m, 6) AS pool_rank_ic_full, round(w.m, 6) AS pool_rank_ic_without_factor, round(f.m - w.m, 6) AS marginal_delta FROM mcm w, (SELECT m FROM mcm WHERE factor = '*full') f WHERE w.factor <> '*full'""",
    ),
)
def _(spark, d):
    return rounded(sc.marginal_ic_contribution(stored_signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d)), 6)


# 0.45 lies between attainable rank correlations of five buckets; 0.5 is one of them, and float noise would decide it.
GATES = dict(min_coverage=0.8, min_abs_monotonicity=0.45, max_pairwise_corr=0.9, max_vif=1e12)
cte(
    "pool_dec", "pool_uni pool_max",
    """SELECT u.factor, coverage >= 0.8 AS coverage_pass, coalesce(abs_monotonicity >= 0.45, false) AS monotonicity_pass, coalesce(max_abs_corr, 0) <= 0.9 AS corr_pass,
    CASE WHEN rank_ic_mean IS NULL OR abs_monotonicity IS NULL THEN 'needs_review' WHEN coverage < 0.8 OR abs_monotonicity < 0.45 THEN 'weak_factor' WHEN max_abs_corr > 0.9 THEN 'redundant_factor' ELSE 'candidate_factor' END AS decision,
    rank_ic_mean, coverage FROM pool_uni u LEFT JOIN pool_max m ON u.factor = m.factor""",
)


def decisions(spark, d, f, label):
    """Screening decisions without the VIF gate."""
    stats = sc.univariate_factor_stats(f, label, max_group=assets_per_date(spark, d))
    merged = stats.join(sc.pairwise_redundancy(f)["max_abs_corr"], "factor", "left").withColumn("vif", F.lit(None).cast("double"))
    return sc.decide(merged, **GATES)


@query("screening_decisions", sql_with("pool_dec", "SELECT factor, coverage_pass, monotonicity_pass, corr_pass AS redundancy_pass, decision FROM pool_dec"))
def _(spark, d):
    return decisions(spark, d, *pool_and_label(spark, d)).select("factor", "coverage_pass", "monotonicity_pass", "redundancy_pass", "decision")


# two factors are the same up to sign: both are inflated without bound, and the others are as without one of the two
inflation_ctes("gate", "pool rev3", "SELECT * FROM pool WHERE factor NOT IN (SELECT factor FROM rev3)", 5)
cte(
    "gate_all", "gate_vif mom3x rev3",
    "SELECT factor, CASE WHEN factor IN (SELECT factor FROM mom3x) THEN cast('inf' as double) ELSE vif END AS vif FROM gate_vif UNION ALL SELECT DISTINCT factor, cast('inf' as double) FROM rev3",
)


@query(
    "screening_with_vif_gate",
    sql_with(
        "pool_uni pool_max gate_all",
        """SELECT u.factor, round(coverage, 8) AS coverage, round(abs_monotonicity, 8) AS abs_monotonicity, round(max_abs_corr, 7) AS max_abs_corr, CASE WHEN vif < 1e6 THEN round(vif, 5) ELSE vif END AS vif,
        CASE WHEN rank_ic_mean IS NULL OR abs_monotonicity IS NULL THEN 'needs_review' WHEN coverage < 0.8 OR abs_monotonicity < 0.45 THEN 'weak_factor'
        WHEN max_abs_corr > 0.9 OR vif > 10 THEN 'redundant_factor' ELSE 'candidate_factor' END AS decision,
        CASE WHEN rank_ic_mean IS NULL OR abs_monotonicity IS NULL THEN 'missing_ic_or_monotonicity' WHEN coverage < 0.8 OR abs_monotonicity < 0.45 THEN 'coverage_or_monotonicity_gate_failed'
        WHEN max_abs_corr > 0.9 OR vif > 10 THEN 'correlation_or_vif_gate_failed' ELSE 'all_primary_gates_passed' END AS decision_reason
        FROM pool_uni u LEFT JOIN pool_max m ON u.factor = m.factor LEFT JOIN gate_all v ON v.factor = u.factor""",
    ),
)
def _(spark, d):
    out = sc.screen_factors(*pool_and_label(spark, d), max_group=assets_per_date(spark, d), **{**GATES, "max_vif": 10.0})
    return rounded(out["decisions"].select("factor", "coverage", "abs_monotonicity", "max_abs_corr", "vif", "decision", "decision_reason"), 8, max_abs_corr=7, vif=5)


cte(
    "chosen", "pool_dec",
    """SELECT factor FROM (SELECT *, count(*) FILTER (decision = 'candidate_factor') OVER () AS n, row_number() OVER (ORDER BY rank_ic_mean DESC NULLS LAST, coverage DESC, factor) AS k FROM pool_dec)
    WHERE CASE WHEN n >= 2 THEN decision = 'candidate_factor' ELSE k <= 2 END""",
)


@query("signals_kept_by_screening", sql_with("pool chosen", "SELECT date, asset, factor, round(value, 8) AS value FROM pool SEMI JOIN chosen USING (factor)"))
def _(spark, d):
    f, label = pool_and_label(spark, d)
    return rounded(sc.select_signals(f, decisions(spark, d, f, label)))


# Multiple testing over one p-value per supplier-like test: a logistic score of the mean return.
cte("tests", "fwd1", "SELECT asset, 1 / (1 + exp(abs(avg(value)) * 40)) AS p_value FROM fwd1 GROUP BY asset")


def tests(spark, d):
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.abs(F.avg("value")) * F.lit(40.0)))
    return fwd1(spark, d).groupBy("asset").agg(p.alias("p_value"))


for _method, _level, _adj in (
    ("bonferroni", "cast(0.05 as double) / n", "p_value * n"),
    ("sidak", "1 - pow(cast(0.95 as double), 1 / n)", "1 - pow(1 - p_value, n)"),
):

    @query(
        f"adjusted_pvalues_{_method}",
        sql_with(
            "tests",
            f"""SELECT asset, round(p_value, 8) AS p_value, '{_method}' AS mt_method, n AS mt_n_tests, round({_level}, 10) AS mt_adjusted_alpha, round(least({_adj}, 1), 7) AS mt_adjusted_pvalue,
            least({_adj}, 1) <= cast(0.05 as double) AS mt_reject FROM (SELECT *, cast(count(*) OVER () as double) AS n FROM tests)""",
        ),
    )
    def _(spark, d, method=_method):
        out = sc.adjust_pvalues(tests(spark, d), method=method).drop("mt_alpha")
        return rounded(out, 7, p_value=8, mt_adjusted_alpha=10)


@query(
    "effective_trial_count",
    sql_with("pool_corr", "SELECT 6 AS n_trials, round(36 / (6 + 2 * sum(corr * corr)), 7) AS effective_trial_count FROM pool_corr".replace("6 AS n_trials", "cast(6 as bigint) AS n_trials")),
)
def _(spark, d):
    return rounded(sc.effective_trial_count(sc.pairwise_correlation(pool(spark, d))), 7)


def tail_ctes(name: str, source: str, points: int = 20_000) -> None:
    """Two-sided Student tail <name>_p of rows (factor, t, df): Simpson's rule for cos^(df - 1) after t = sqrt(df) tan(theta)."""
    area = lambda low: f"sum(w * pow(cos({low} + (pi() / 2 - {low}) * i / {points}), df - 1)) * (pi() / 2 - {low})"
    cte(
        f"{name}_p", source,
        f"""SELECT factor, least(1, far / whole) AS p FROM (SELECT factor, {area("edge")} AS far, {area("0")} AS whole FROM (SELECT factor, df, atan(abs(t) / sqrt(df)) AS edge FROM {source}) a,
        (SELECT i, CASE WHEN i IN (0, {points}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM (SELECT cast(unnest(range({points} + 1)) as double) AS i)) g GROUP BY factor, edge)""",
    )


def ic_t_cte(name: str, ic: str) -> None:
    cte(name, ic, f"SELECT factor, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) * sqrt(cast(count(rank_ic) as double)) AS t, cast(count(rank_ic) - 1 as double) AS df FROM {ic} GROUP BY factor")


ic_t_cte("sig_t", "sig_ic")
tail_ctes("sig_t", "sig_t")


@query(
    "rank_ic_pvalues",
    sql_with("sig_t sig_t_p", "SELECT t.factor, round(t, 5) AS t_stat, cast(df + 1 as bigint) AS n_obs, round(p, 6) AS p_value, round(least(3 * p, 1), 6) AS adjusted_p_value FROM sig_t t JOIN sig_t_p p ON t.factor = p.factor"),
)
def _(spark, d):
    ic = ev.compute_rank_ic(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d))
    return rounded(sc.ic_pvalues(ev.compute_ic_summary(ic, value_col="rank_ic", by=("factor",)), trial_count=3), 6, t_stat=5)


# Composite signals.
@query("ic_history", sql_with("sig_ic", "SELECT date, factor, round(rank_ic, 8) AS rank_ic FROM sig_ic"))
def _(spark, d):
    return rounded(cp.ic_history(signals(spark, d), fwd1(spark, d), max_group=assets_per_date(spark, d)))


def weight_ctes(name: str, score: str, source: str = "signals", ic: str = "sig_ic") -> None:
    cte(
        f"{name}_s", f"{source} {ic}",
        f"""SELECT date, factor, CASE WHEN s IS NOT NULL THEN greatest(s, 0) END AS s FROM (SELECT g.date, g.factor, CASE WHEN count(h.date) >= 5 THEN {score} END AS s FROM (
        SELECT d.date, f.factor FROM (SELECT DISTINCT date FROM {source}) d CROSS JOIN (SELECT DISTINCT factor FROM {source}) f) g
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date) AS k FROM {ic}) h ON h.factor = g.factor AND h.date < g.date
        AND h.k > (SELECT count(*) FROM {ic} b WHERE b.factor = g.factor AND b.date < g.date) - 12 GROUP BY 1, 2)""",
    )
    cte(
        name, f"{name}_s",
        "SELECT date, factor, CASE WHEN coalesce(sum(s) OVER w, 0) > 0 THEN coalesce(s / sum(s) OVER w, 0) ELSE 1 / cast(count(*) OVER w as double) END AS weight FROM " + f"{name}_s WINDOW w AS (PARTITION BY date)",
    )


weight_ctes("cw_ic", "avg(rank_ic)")
weight_ctes("cw_icir", "avg(rank_ic) / nullif(stddev_samp(rank_ic), 0)")
COMPOSE = dict(lookback=12, min_history=5)


@query("composite_weights_ic", sql_with("cw_ic", "SELECT date, factor, round(weight, 7) AS weight FROM cw_ic"))
def _(spark, d):
    out = cp.composite_weights(stored_signals(spark, d), method="ic", labels=fwd1(spark, d), max_group=assets_per_date(spark, d), **COMPOSE)
    return rounded(out, 7)


@query("composite_weights_icir", sql_with("cw_icir", "SELECT date, factor, round(weight, 7) AS weight FROM cw_icir"))
def _(spark, d):
    out = cp.composite_weights(stored_signals(spark, d), method="icir", labels=fwd1(spark, d), max_group=assets_per_date(spark, d), **COMPOSE)
    return rounded(out, 7)


def compose_ctes(prefix: str, source: str, weights: str) -> None:
    """CTEs <prefix>part, <prefix>flat and <prefix>omposite of z-scores times weights."""
    z, part, flat = f"{prefix}z", f"{prefix}part", f"{prefix}flat"
    cte(z, source, f"SELECT *, count(value) OVER w AS n, min(value) OVER w = max(value) OVER w AS flat, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM {source} WINDOW w AS (PARTITION BY date, factor)")
    cte(part, f"{z} {weights}", f"SELECT z.date, z.asset, z.factor, z * weight AS part, weight FROM {z} z JOIN {weights} w ON z.date = w.date AND z.factor = w.factor WHERE n >= 2 AND NOT flat AND value IS NOT NULL")
    cte(flat, f"{z} {weights}", f"SELECT z.date, z.factor, any_value(weight) AS weight FROM {z} z JOIN {weights} w ON z.date = w.date AND z.factor = w.factor WHERE n >= 2 AND flat GROUP BY 1, 2")
    cte(
        f"{prefix}omposite", f"{part} {flat} {source}",
        f"""SELECT a.date, a.asset, 'composite_signal' AS factor, coalesce(s, 0) / nullif(coalesce(w, 0) + coalesce(c, 0), 0) AS value FROM (SELECT DISTINCT date, asset FROM {source}) a
        LEFT JOIN (SELECT date, asset, sum(part) AS s, sum(abs(weight)) AS w FROM {part} GROUP BY 1, 2) p ON p.date = a.date AND p.asset = a.asset
        LEFT JOIN (SELECT date, sum(abs(weight)) AS c FROM {flat} GROUP BY 1) f ON f.date = a.date WHERE w IS NOT NULL OR c IS NOT NULL""",
    )


compose_ctes("c", "signals", "cw_icir")


def composed(spark, d):
    return cp.compose_signals(stored_signals(spark, d), method="icir", labels=fwd1(spark, d), max_group=assets_per_date(spark, d), **COMPOSE)


@query("composite_signal", sql_with("composite", "SELECT date, asset, factor, round(value, 6) AS value FROM composite"))
def _(spark, d):
    return rounded(composed(spark, d)["composite"], 6)


@query(
    "composite_attribution",
    sql_with("cpart cflat", "SELECT date, factor, round(avg(abs(part)), 6) AS mean_abs_component FROM cpart GROUP BY 1, 2 UNION ALL SELECT date, factor, cast(0 as double) FROM cflat"),
)
def _(spark, d):
    return rounded(composed(spark, d)["attribution"], 6)


@query(
    "composite_diagnostics",
    sql_with("composite", "SELECT date, count(DISTINCT asset) AS n_assets, cast(3 as integer) AS n_factors, round(avg(cast(value IS NOT NULL as double)), 8) AS coverage FROM composite GROUP BY date"),
)
def _(spark, d):
    return rounded(composed(spark, d)["diagnostics"])


# Alpha pool.
def alpha_ctes(panel: str, corr: str, ls: str) -> None:
    cte(
        panel, ls,
        f"""SELECT d.date, f.factor, coalesce(l.long_short_return, 0) AS value FROM (SELECT date FROM {ls} GROUP BY 1 HAVING count(long_short_return) > 0) d CROSS JOIN (SELECT DISTINCT factor FROM {ls}) f
        LEFT JOIN {ls} l ON l.date = d.date AND l.factor = f.factor""",
    )
    cte(
        corr, panel,
        f"SELECT p.factor AS alpha_a, q.factor AS alpha_b, {corr_sql('p.value', 'q.value')} AS corr FROM {panel} p JOIN {panel} q ON p.date = q.date AND p.factor < q.factor GROUP BY 1, 2",
    )


alpha_ctes("apanel", "acorr", "pool_ls")


def alpha_panel(spark, d):
    return cp.alpha_return_panel(*pool_and_label(spark, d), max_group=assets_per_date(spark, d))


@query("alpha_return_panel", sql_with("apanel", "SELECT date, factor, round(value, 8) AS value FROM apanel"))
def _(spark, d):
    return rounded(alpha_panel(spark, d))


@query("alpha_correlations", sql_with("acorr", "SELECT alpha_a, alpha_b, round(corr, 7) AS corr, round(abs(corr), 7) AS abs_corr FROM acorr"))
def _(spark, d):
    return rounded(cp.alpha_correlations(alpha_panel(spark, d)), 7)


BREADTH = sql_with(
        "acorr",
        """SELECT cast(6 as bigint) AS n_alphas, round(avg(abs(corr)), 7) AS avg_abs_corr, round(36 / (6 + 2 * sum(corr * corr)), 6) AS effective_breadth, round(6 / (6 + 2 * sum(corr * corr)), 7) AS breadth_ratio,
        round(sqrt(36 / (6 + 2 * sum(corr * corr))), 7) AS ir_multiplier_bound FROM acorr""",
    )


@query("breadth_summary", BREADTH)
def _(spark, d):
    return rounded(cp.breadth_summary(cp.alpha_correlations(alpha_panel(spark, d))), 7, effective_breadth=6)


THRESHOLD = 0.6
cte("cl_edge", "acorr", "SELECT alpha_a AS a, alpha_b AS b FROM acorr WHERE abs(corr) >= 0.6 UNION ALL SELECT alpha_b, alpha_a FROM acorr WHERE abs(corr) >= 0.6")
# Reachability as a recursive CTE: the one place where SQL needs recursion.
cte(
    "cl_reach", "acorr cl_edge",
    "SELECT n AS a, n AS b FROM (SELECT alpha_a AS n FROM acorr UNION SELECT alpha_b FROM acorr) UNION SELECT r.a, e.b FROM cl_reach r JOIN cl_edge e ON e.a = r.b",
)
cte("clusters", "cl_reach", "SELECT a AS name, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM (SELECT a, min(b) AS root FROM cl_reach GROUP BY a)")


@query("correlation_clusters", sql_with("clusters", "SELECT name, cast(cluster_id as integer) AS cluster_id FROM clusters"))
def _(spark, d):
    return cp.correlation_clusters(cp.alpha_correlations(alpha_panel(spark, d)), threshold=THRESHOLD)


@query("cluster_summary", sql_with("clusters", "SELECT cast(cluster_id as integer) AS cluster_id, count(*) AS n_alphas, string_agg(name, '|' ORDER BY name) AS members FROM clusters GROUP BY 1"))
def _(spark, d):
    return cp.alpha_pool_diagnostics(alpha_panel(spark, d), cluster_threshold=THRESHOLD)["clusters"]


@query(
    "cluster_importance",
    sql_with(
        "clusters pool_uni",
        """SELECT cast(cluster_id as integer) AS cluster_id, count(DISTINCT name) AS n_features, round(coalesce(sum(rank_ic_mean), 0), 7) AS importance_sum, round(avg(rank_ic_mean), 7) AS importance_mean
        FROM clusters c LEFT JOIN pool_uni u ON c.name = u.factor GROUP BY 1""",
    ),
)
def _(spark, d):
    f, label = pool_and_label(spark, d)
    pairs, n = ev.aligned(f, label), assets_per_date(spark, d)
    clusters = cp.correlation_clusters(cp.alpha_correlations(cp.alpha_returns_of_pairs(pairs, max_group=n)), threshold=THRESHOLD).withColumnRenamed("name", "feature")
    stats = sc.univariate_factor_stats(f, label, max_group=n, pairs=pairs)
    scores = stats.select(F.col("factor").alias("feature"), "rank_ic_mean")
    return rounded(imp.cluster_importance(scores, clusters, importance_col="rank_ic_mean"), 7)


# Feature importance: the next return explained by three factors.
FEATURES = ["low_volatility_4d", "reversal_2d", "value_book_to_price_proxy"]


def learning_table(spark, d):
    wide = stored_signals(spark, d).groupBy("date", "asset").pivot("factor", FEATURES).agg(F.first("value"))
    label = fwd1(spark, d).select("date", "asset", F.col("value").alias("label"))
    return materialize(imp.contiguous_folds(wide.join(label, ["date", "asset"]).dropna(), order=["date", "asset"]))


# no SQL for fitted models: tests hold them against a linear model with known answers
@query("mdi_importance")
def _(spark, d):
    df = learning_table(spark, d)
    model = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=8, maxDepth=4, seed=7).fit(imp.assemble(df, FEATURES))
    return imp.mdi_importance(model, FEATURES, df)


@query("mda_importance")
def _(spark, d):
    r2 = RegressionEvaluator(labelCol="label", metricName="r2")
    return imp.mda_importance(LinearRegression(labelCol="label"), learning_table(spark, d), FEATURES, r2, row_id=("date", "asset"))


@query("sfi_importance")
def _(spark, d):
    r2 = RegressionEvaluator(labelCol="label", metricName="r2")
    return imp.sfi_importance(lambda: LinearRegression(labelCol="label"), learning_table(spark, d), FEATURES, r2)
