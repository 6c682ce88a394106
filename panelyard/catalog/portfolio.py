"""Portfolio construction, returns, turnover and target weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.panels import assets_per_date, avg_rank_sql, cte, fwd1, mom3, px, sql_with
from panelyard.catalog.registry import query
from panelyard.catalog.transforms import research_universe
from panelyard.functions.columns import rounded
from panelyard.operators import portfolio as pf
from panelyard.operators import target_weights as tw
from panelyard.operators.evaluation import apply_linear_cost

def valid_cte(name: str, source: str) -> None:
    cte(name, source, f"SELECT date, asset, value, count(*) OVER (PARTITION BY date) AS n FROM {source} WHERE value IS NOT NULL")


valid_cte("pf_valid", "mom3")


def legs_cte(name: str, top: int, bottom: int | None, valid: str = "pf_valid") -> None:
    shorts = (
        f""" UNION ALL SELECT date, asset, -value AS v, -1 AS leg FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value, asset DESC) AS k FROM {valid} WHERE n >= 2) WHERE k <= least({bottom}, n - least({top}, n))"""
        if bottom
        else ""
    )
    cte(
        name, valid,
        f"SELECT date, asset, value AS v, 1 AS leg FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY value DESC, asset) AS k FROM {valid} WHERE n >= 2) WHERE k <= {top}{shorts}",
    )


EQUAL = "1 / cast(count(*) OVER (PARTITION BY date, leg) as double)"
legs_cte("legs", 15, 10)
cte("w_equal", "legs", f"SELECT date, asset, leg * {EQUAL} AS weight FROM legs")
def rank_weights_cte(name: str, legs: str) -> None:
    cte(name, legs, f"SELECT date, asset, leg * r / sum(r) OVER (PARTITION BY date, leg) AS weight FROM (SELECT *, {avg_rank_sql('date, leg', 'v')} AS r FROM {legs})")


rank_weights_cte("w_rank", "legs")
cte(
    "w_score", "legs",
    f"SELECT date, asset, leg * CASE WHEN sum(x) OVER (PARTITION BY date, leg) > 0 THEN x / sum(x) OVER (PARTITION BY date, leg) ELSE {EQUAL} END AS weight FROM (SELECT *, v - min(v) OVER (PARTITION BY date, leg) AS x FROM legs)",
)
cte("w_all", "pf_valid", "SELECT date, asset, r / sum(r) OVER (PARTITION BY date) AS weight FROM (SELECT *, " + avg_rank_sql("date", "value") + " AS r FROM pf_valid WHERE n >= 2)")


@query("portfolio_weights_equal", sql_with("w_equal", "SELECT date, asset, weight FROM w_equal"))
def _(spark, d):
    return pf.portfolio_weights(mom3(spark, d), "equal", top_k=15, bottom_k=10)


@query("portfolio_weights_rank", sql_with("w_rank", "SELECT date, asset, round(weight, 10) AS weight FROM w_rank"))
def _(spark, d):
    return rounded(pf.portfolio_weights(mom3(spark, d), "rank", top_k=15, bottom_k=10), 10)


@query("portfolio_weights_score", sql_with("w_score", "SELECT date, asset, round(weight, 8) AS weight FROM w_score"))
def _(spark, d):
    return rounded(pf.portfolio_weights(mom3(spark, d), "score", top_k=15, bottom_k=10))


@query("portfolio_weights_all_assets", sql_with("w_all", "SELECT date, asset, round(weight, 10) AS weight FROM w_all"))
def _(spark, d):
    return rounded(pf.portfolio_weights(mom3(spark, d), "rank", max_group=assets_per_date(spark, d)), 10)


def returns_cte(name: str, weights: str, returns: str, hold: int, freq: int, key: str = "") -> None:
    """Range-join formulation: position i lives from its date until the date of position i + hold."""
    k, same = (f"{key}, ", f"AND p.{key} = r.{key}") if key else ("", "")
    pk, part = (f"p.{key}, ", f"PARTITION BY {key}") if key else ("", "")
    weq = f"AND w.{key} = p.{key}" if key else ""
    cte(
        name, f"{weights} {returns}",
        f"""SELECT {k}date, avg(p) AS portfolio_return FROM (SELECT {pk}r.date, p.date AS start, coalesce(sum(w.weight * r.value), 0) AS p FROM (
        SELECT {k}date, lead(date, {hold}) OVER ({part} ORDER BY date) AS expiry FROM (SELECT {k}date, row_number() OVER ({part} ORDER BY date) - 1 AS n FROM (SELECT DISTINCT {k}date FROM {weights})) WHERE n % {freq} = 0) p
        JOIN {weights} w ON w.date = p.date {weq} JOIN {returns} r ON r.asset = w.asset AND r.date >= p.date AND (p.expiry IS NULL OR r.date < p.expiry) {same} GROUP BY ALL) GROUP BY {k}date""",
    )


returns_cte("pf_ret", "w_rank", "fwd1", 3, 2)


@query("overlapping_portfolio_returns", sql_with("pf_ret", "SELECT date, round(portfolio_return, 8) AS portfolio_return FROM pf_ret"))
def _(spark, d):
    weights = pf.portfolio_weights(mom3(spark, d), "rank", top_k=15, bottom_k=10)
    return rounded(pf.simulate_portfolio_returns(weights, fwd1(spark, d), holding_period=3, rebalance_frequency=2))


def turnover_cte(name: str, weights: str, first: str = "NULL", key: str = "") -> None:
    k = f"{key}, " if key else ""
    part = f"PARTITION BY {key}" if key else ""
    ek = f"AND c.{key} = d.{key}" if key else ""
    ep = f"AND p.{key} = d.{key}" if key else ""
    dk = f"d.{key}, " if key else ""
    cte(
        name, weights,
        f"""SELECT {k}date, CASE WHEN prev IS NULL THEN {first} ELSE sum(abs(cw - pw)) / 2 END AS portfolio_turnover FROM (
        SELECT {dk}d.date, d.prev, c.asset, c.weight AS cw, coalesce(p.weight, 0) AS pw FROM (SELECT {k}date, lag(date) OVER ({part} ORDER BY date) AS prev FROM (SELECT DISTINCT {k}date FROM {weights})) d
        JOIN {weights} c ON c.date = d.date {ek} LEFT JOIN {weights} p ON p.date = d.prev AND p.asset = c.asset {ep}
        UNION ALL SELECT {dk}d.date, d.prev, p.asset, 0, p.weight FROM (SELECT {k}date, lag(date) OVER ({part} ORDER BY date) AS prev FROM (SELECT DISTINCT {k}date FROM {weights})) d
        JOIN {weights} p ON p.date = d.prev {ep} ANTI JOIN {weights} c ON c.date = d.date AND c.asset = p.asset {ek}) GROUP BY {k}date, prev""",
    )


turnover_cte("pf_to", "w_rank")


@query("portfolio_turnover", sql_with("pf_to", "SELECT date, round(portfolio_turnover, 8) AS portfolio_turnover FROM pf_to"))
def _(spark, d):
    return rounded(pf.portfolio_turnover(pf.portfolio_weights(mom3(spark, d), "rank", top_k=15, bottom_k=10)))


cte("w_active", "w_rank", "SELECT w.* FROM w_rank w SEMI JOIN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS n FROM (SELECT DISTINCT date FROM w_rank)) WHERE n % 2 = 0) a ON w.date = a.date")
turnover_cte("pf_to_active", "w_active")
cte(
    "pf_cost", "pf_ret pf_to_active",
    "SELECT r.date, portfolio_return, portfolio_return - cast(0.002 as double) * CASE WHEN t.date IS NULL THEN 0 ELSE portfolio_turnover END AS adjusted_return FROM pf_ret r LEFT JOIN pf_to_active t ON r.date = t.date",
)
SPEC = pf.Strategy(long_top_k=15, short_bottom_k=10, weighting_method="rank", holding_period=3, rebalance_frequency=2)


@query("cost_adjusted_portfolio_returns", sql_with("pf_cost", "SELECT date, round(portfolio_return, 8) AS portfolio_return, round(adjusted_return, 8) AS adjusted_return FROM pf_cost"))
def _(spark, d):
    return rounded(pf.portfolio_block(mom3(spark, d), fwd1(spark, d), SPEC, cost_rate=0.002)["cost_adjusted"])


@query("linear_cost", sql_with("pf_ret pf_to", "SELECT r.date, round(portfolio_return - cast(0.001 as double) * portfolio_turnover, 8) AS adjusted_return FROM pf_ret r JOIN pf_to t ON r.date = t.date"))
def _(spark, d):
    weights = pf.portfolio_weights(mom3(spark, d), "rank", top_k=15, bottom_k=10)
    ret = pf.simulate_portfolio_returns(weights, fwd1(spark, d), holding_period=3, rebalance_frequency=2)
    out = apply_linear_cost(
        ret.join(pf.portfolio_turnover(weights), "date"), 0.001, return_col="portfolio_return", turnover_col="portfolio_turnover"
    )
    return rounded(out.select("date", "adjusted_return"))


@query(
    "portfolio_summary",
    sql_with(
        "pf_ret pf_to_active pf_cost",
        """SELECT round(avg(portfolio_return), 8) AS mean_portfolio_return, round(avg(cast(portfolio_return > 0 as double)), 8) AS portfolio_hit_rate,
        round((SELECT avg(portfolio_turnover) FROM pf_to_active), 8) AS mean_portfolio_turnover, round((SELECT avg(adjusted_return) FROM pf_cost), 8) AS mean_cost_adjusted_return, count(*) AS n_portfolio_dates FROM pf_ret""",
    ),
)
def _(spark, d):
    return rounded(pf.summarise_portfolio(pf.portfolio_block(mom3(spark, d), fwd1(spark, d), SPEC, cost_rate=0.002)))


def plan_cte(name: str, weights: str) -> None:
    cte(
        name, f"{weights} px",
        f"""SELECT t.date, t.asset, trade_weight, trade_weight * cast(1000000 as double) AS trade_dollar, target_weight, dollar_volume AS adv_dollar, daily_volatility FROM (
        SELECT *, target_weight - coalesce(lag(target_weight) OVER (PARTITION BY asset ORDER BY date), 0) AS trade_weight FROM (
        SELECT d.date, a.asset, coalesce(w.weight, 0) AS target_weight FROM (SELECT DISTINCT date FROM {weights}) d CROSS JOIN (SELECT DISTINCT asset FROM {weights}) a LEFT JOIN {weights} w ON w.date = d.date AND w.asset = a.asset)) t
        LEFT JOIN (SELECT date, asset, dollar_volume, CASE WHEN count(r) OVER f >= 2 THEN stddev_pop(r) OVER f END AS daily_volatility FROM (
        SELECT *, close / lag(close) OVER (PARTITION BY asset ORDER BY date) - 1 AS r FROM px) WINDOW f AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)) p ON p.date = t.date AND p.asset = t.asset""",
    )


plan_cte("plan", "w_rank")


def plan(spark, d):
    weights = pf.portfolio_weights(mom3(spark, d), "rank", top_k=15, bottom_k=10)
    return pf.trade_plan(weights, px(spark, d), portfolio_value=1000000.0, adv_window=6)


@query(
    "trade_plan",
    sql_with("plan", "SELECT date, asset, round(trade_weight, 8) AS trade_weight, round(trade_dollar, 4) AS trade_dollar, round(target_weight, 8) AS target_weight, adv_dollar, round(daily_volatility, 8) AS daily_volatility FROM plan"),
)
def _(spark, d):
    return rounded(plan(spark, d), 8, trade_dollar=4)


# Target weights: momentum as the signal with the universe masks.
cte("tw_in", "mom3 uni", "SELECT m.date, m.asset, value AS s, in_universe, is_tradable, in_universe AND is_tradable AND value IS NOT NULL AS run FROM mom3 m JOIN uni u ON m.date = u.date AND m.asset = u.asset")


def signal_and_masks(spark, d):
    out = research_universe(spark, d)
    signal = mom3(spark, d).select("date", "asset", F.col("value").alias("signal_value"))
    return signal, out["universe"], out["tradability"]


@query("executable_mask", sql_with("tw_in", "SELECT date, asset, round(s, 8) AS signal_value, in_universe, is_tradable, run AS is_executable FROM tw_in"))
def _(spark, d):
    return rounded(tw.executable_mask(*signal_and_masks(spark, d)))


def limits_ctes(name: str, raw: str, pc: tw.Construction) -> None:
    """CTEs for the constraints, diagnostics and warnings of raw weights (date, asset, run, w)."""
    gross = f"cast({pc.gross_limit * (1 - pc.cash_buffer)!r} as double)"
    small = f"CASE WHEN abs(w) < {pc.min_weight!r} THEN 0 ELSE w END" if pc.min_weight is not None else "w"
    if pc.long_short:
        net = f"greatest(least(p - n, cast({pc.net_limit!r} as double)), -cast({pc.net_limit!r} as double))"
        scaled = f"""CASE WHEN p > 0 AND n > 0 THEN greatest(w, 0) * ({gross} + {net}) / 2 / p - greatest(-w, 0) * ({gross} - {net}) / 2 / n
        WHEN p + n > 0 THEN w * {gross} / (p + n) ELSE 0 END"""
        low = f"-cast({pc.max_weight!r} as double)"
    else:
        budget = min(pc.gross_limit * (1 - pc.cash_buffer), pc.net_limit) if pc.net_limit > 0 else pc.gross_limit * (1 - pc.cash_buffer)
        scaled, low = f"CASE WHEN p > 0 THEN greatest(w, 0) * cast({budget!r} as double) / p ELSE 0 END", "0"
        small = f"greatest({small}, 0)"
    cte(
        f"{name}_s", raw,
        f"SELECT *, {scaled} AS scaled FROM (SELECT *, sum(greatest(w, 0)) OVER (PARTITION BY date) AS p, sum(greatest(-w, 0)) OVER (PARTITION BY date) AS n FROM (SELECT * REPLACE ({small} AS w) FROM {raw}))",
    )
    cte(name, f"{name}_s", f"SELECT date, asset, run, in_universe, scaled, p, n, CASE WHEN run THEN greatest(least(scaled, cast({pc.max_weight!r} as double)), {low}) ELSE cast(0 as double) END AS tw FROM {name}_s")


TOPK = tw.Construction(top_k=20, cash_buffer=0.05, max_weight=0.04, net_limit=1.0)
cte(
    "raw_topk", "tw_in",
    "SELECT date, asset, run, in_universe, CASE WHEN k <= 20 THEN 1 / cast(least(20, m) as double) ELSE cast(0 as double) END AS w FROM (SELECT *, CASE WHEN run THEN row_number() OVER (PARTITION BY date, run ORDER BY s DESC, asset) END AS k, count(*) FILTER (run) OVER (PARTITION BY date) AS m FROM tw_in)",
)
limits_ctes("tw_topk", "raw_topk", TOPK)


@query("target_weights_topk", sql_with("tw_topk", "SELECT date, asset, round(tw, 10) AS target_weight FROM tw_topk"))
def _(spark, d):
    out = tw.build_target_weights(*signal_and_masks(spark, d), TOPK, max_group=assets_per_date(spark, d))
    return rounded(out["target_weights"].select("date", "asset", "target_weight"), 10)


LS = tw.Construction(top_k=12, bottom_k=8, long_short=True, gross_limit=1.5, net_limit=0.25, max_weight=0.1)
cte(
    "raw_ls", "tw_in",
    """SELECT date, asset, run, in_universe, CASE WHEN k <= 12 THEN 1 / cast(least(12, m) as double) WHEN j <= 8 AND run THEN -1 / cast(least(8, m - least(12, m)) as double) ELSE cast(0 as double) END AS w, m - least(12, m) AS remaining FROM (
    SELECT *, CASE WHEN run AND k > 12 THEN row_number() OVER (PARTITION BY date, run AND k > 12 ORDER BY s, asset) END AS j FROM (
    SELECT *, CASE WHEN run THEN row_number() OVER (PARTITION BY date, run ORDER BY s DESC, asset) END AS k, count(*) FILTER (run) OVER (PARTITION BY date) AS m FROM tw_in))""",
)
limits_ctes("tw_ls", "raw_ls", LS)


@query("target_weights_long_short", sql_with("tw_ls", "SELECT date, asset, round(tw, 10) AS target_weight FROM tw_ls"))
def _(spark, d):
    out = tw.build_target_weights(*signal_and_masks(spark, d), LS, max_group=assets_per_date(spark, d))
    return rounded(out["target_weights"].select("date", "asset", "target_weight"), 10)


ZS = tw.Construction(
    construction_method="full_universe", weight_method="score", long_short=True, gross_limit=1.0, net_limit=0.1, cash_buffer=0.1,
    min_weight=0.2, max_weight=0.05, weight_clip=2.0,
)
cte(
    "raw_z", "tw_in",
    """SELECT date, asset, run, in_universe, CASE WHEN run AND lo < hi THEN greatest(least((s - mu) / sd, 2), -2) ELSE cast(0 as double) END AS w FROM (
    SELECT *, avg(s) FILTER (run) OVER (PARTITION BY date) AS mu, stddev_pop(s) FILTER (run) OVER (PARTITION BY date) AS sd, min(s) FILTER (run) OVER (PARTITION BY date) AS lo, max(s) FILTER (run) OVER (PARTITION BY date) AS hi FROM tw_in)""",
)
limits_ctes("tw_z", "raw_z", ZS)


@query("target_weights_zscore", sql_with("tw_z", "SELECT date, asset, round(tw, 8) AS target_weight FROM tw_z"))
def _(spark, d):
    # No bound: statistics and ranks take their split strategy.
    out = tw.build_target_weights(*signal_and_masks(spark, d), ZS)
    return rounded(out["target_weights"].select("date", "asset", "target_weight"))


@query(
    "target_weight_diagnostics",
    sql_with(
        "tw_ls",
        """SELECT date, round(sum(abs(tw)), 8) AS gross_exposure, round(sum(tw), 8) AS net_exposure, count(*) FILTER (tw <> 0) AS n_positions, count(*) FILTER (run) AS n_executable_assets,
        count(*) FILTER (in_universe) AS n_universe_assets FROM tw_ls GROUP BY date""",
    ),
)
def _(spark, d):
    return rounded(tw.build_target_weights(*signal_and_masks(spark, d), LS, max_group=assets_per_date(spark, d))["diagnostics"])


@query(
    "target_weight_warnings",
    sql_with(
        "tw_ls raw_ls",
        """SELECT date, code FROM (SELECT t.date, count(*) FILTER (t.run) AS run, max(remaining) AS remaining, max(p) AS p, max(n) AS n, bool_or(abs(scaled) > 0.1) AS over FROM tw_ls t JOIN raw_ls r ON t.date = r.date AND t.asset = r.asset GROUP BY 1)
        CROSS JOIN (SELECT unnest(['no_executable_assets', 'insufficient_short_candidates', 'long_short_side_missing', 'max_weight_clipped']) AS code)
        WHERE CASE code WHEN 'no_executable_assets' THEN run = 0 WHEN 'insufficient_short_candidates' THEN run > 0 AND remaining < 8 WHEN 'long_short_side_missing' THEN run > 0 AND p + n > 0 AND (p = 0 OR n = 0) ELSE run > 0 AND over END""",
    ),
)
def _(spark, d):
    return tw.build_target_weights(*signal_and_masks(spark, d), LS, max_group=assets_per_date(spark, d))["warnings"]
