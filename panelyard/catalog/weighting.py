"""Sample weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.panels import cte, px, sql_with
from panelyard.catalog.registry import query
from panelyard.catalog.validation import intervals
from panelyard.functions.columns import rounded
from panelyard.functions.storage import materialize
from panelyard.operators import sample_weights as sw

cte(
    "cal", "iv",
    "SELECT cast(d as date) AS date FROM (SELECT unnest(generate_series((SELECT min(event_start) FROM iv)::timestamp, (SELECT max(event_end) FROM iv)::timestamp, interval 1 day)) AS d) WHERE isodow(d) <= 5",
)
cte("ends_by_day", "iv", "SELECT event_start, event_end, count(*) AS n FROM iv GROUP BY 1, 2")
cte("conc", "cal ends_by_day", "SELECT date, cast(coalesce(sum(n), 0) as double) AS concurrency FROM cal LEFT JOIN ends_by_day ON event_start <= date AND event_end >= date GROUP BY date")


@query("event_concurrency", sql_with("conc", "SELECT date, concurrency FROM conc"))
def _(spark, d):
    return sw.concurrency_by_date(intervals(spark, d))


cte(
    "uniq", "iv conc ends_by_day",
    """SELECT sample_id, u / sum(u) OVER () AS w FROM (SELECT i.sample_id, coalesce(m, 0) AS u FROM iv i LEFT JOIN (
    SELECT e.event_start, e.event_end, avg(1 / concurrency) AS m FROM ends_by_day e JOIN conc c ON c.date BETWEEN e.event_start AND e.event_end WHERE concurrency > 0 GROUP BY 1, 2) k
    ON i.event_start = k.event_start AND i.event_end = k.event_end)""",
)
_N = 1000000.0


def _scaled(df, *cols):
    """Weights of a whole table are tiny; report them per million."""
    return rounded(df.withColumns({c: F.col(c) * F.lit(_N) for c in cols}), 6)


@query("uniqueness_weights", sql_with("uniq", "SELECT sample_id, round(w * 1000000.0, 6) AS weight_uniqueness FROM uniq"))
def _(spark, d):
    return _scaled(sw.uniqueness_weights(intervals(spark, d)).select("sample_id", "weight_uniqueness"), "weight_uniqueness")


cte(
    "retw", "iv",
    "SELECT sample_id, w / sum(w) OVER () AS w FROM (SELECT sample_id, coalesce(least(abs(v), (SELECT quantile_cont(abs(v), 0.99) FROM iv)), 0) AS w FROM iv)",
)


@query("return_magnitude_weights", sql_with("retw", "SELECT sample_id, round(w * 1000000.0, 6) AS weight_return_magnitude FROM retw"))
def _(spark, d):
    iv = materialize(intervals(spark, d).select("sample_id", "v"))
    return _scaled(sw.return_magnitude_weights(iv, return_col="v"), "weight_return_magnitude").select("sample_id", "weight_return_magnitude")


cte(
    "decayw", "iv",
    """SELECT sample_id, w / sum(w) OVER () AS w FROM (SELECT sample_id, pow(cast(2 as double), -(max(k) OVER () - k) / cast(12 as double)) AS w FROM iv JOIN (
    SELECT decision_date, row_number() OVER (ORDER BY decision_date) AS k FROM (SELECT DISTINCT decision_date FROM iv)) d ON iv.decision_date = d.decision_date)""",
)


@query("time_decay_weights", sql_with("decayw", "SELECT sample_id, round(w * 1000000.0, 6) AS weight_time_decay FROM decayw"))
def _(spark, d):
    return _scaled(sw.time_decay_weights(intervals(spark, d), half_life_periods=12).select("sample_id", "weight_time_decay"), "weight_time_decay")


cte(
    "confw", "iv",
    """SELECT sample_id, w / sum(w) OVER () AS w FROM (SELECT sample_id, cast(0.1 as double) + cast(0.9 as double) * coalesce((abs(v) - lo) / (hi - lo), 0) AS w FROM iv, (SELECT min(abs(v)) AS lo, max(abs(v)) AS hi FROM iv))""",
)


@query("confidence_weights", sql_with("confw", "SELECT sample_id, round(w * 1000000.0, 6) AS weight_confidence FROM confw"))
def _(spark, d):
    df = intervals(spark, d).select("sample_id", F.abs("v").alias("c"))
    return _scaled(sw.confidence_weights(df, confidence_col="c").select("sample_id", "weight_confidence"), "weight_confidence")


cte(
    "allw", "uniq retw decayw confw",
    """SELECT u.sample_id, u.w AS wu, r.w AS wr, c.w AS wc, t.w AS wt, u.w * r.w * c.w * t.w / sum(u.w * r.w * c.w * t.w) OVER () AS w
    FROM uniq u JOIN retw r ON u.sample_id = r.sample_id JOIN confw c ON u.sample_id = c.sample_id JOIN decayw t ON u.sample_id = t.sample_id""",
)


def sample_weights(spark, d):
    events = intervals(spark, d).withColumn("c", F.abs("v"))
    return sw.build_sample_weights(events, return_col="v", confidence_col="c", half_life_periods=12)


@query(
    "combined_weight_components",
    sql_with(
        "iv uniq decayw",
        "SELECT sample_id, round(w * 1000000.0, 6) AS sample_weight FROM (SELECT u.sample_id, u.w * t.w / sum(u.w * t.w) OVER () AS w FROM uniq u JOIN decayw t ON u.sample_id = t.sample_id)",
    ),
)
def _(spark, d):
    df = sw.time_decay_weights(sw.uniqueness_weights(materialize(intervals(spark, d))), half_life_periods=12)
    return _scaled(sw.combine_weight_components(df, ["weight_uniqueness", "weight_time_decay"]).select("sample_id", "sample_weight"), "sample_weight")


@query(
    "sample_weight_table",
    sql_with(
        "iv allw",
        """SELECT i.sample_id, decision_date, event_start, event_end, round(wu * 1000000.0, 6) AS weight_uniqueness, round(wr * 1000000.0, 6) AS weight_return_magnitude,
        round(wc * 1000000.0, 6) AS weight_confidence, round(wt * 1000000.0, 6) AS weight_time_decay, round(w * 1000000.0, 6) AS sample_weight FROM iv i JOIN allw a ON i.sample_id = a.sample_id""",
    ),
)
def _(spark, d):
    out = sample_weights(spark, d)
    return _scaled(out, *[c for c in out.columns if c.startswith("weight_")], "sample_weight")


@query(
    "attached_sample_weights",
    sql_with("px allw", "SELECT p.date, p.asset, round(w * 1000000.0, 6) AS sample_weight FROM px p LEFT JOIN allw a ON a.sample_id = strftime(p.date, '%Y-%m-%d') || '|' || p.asset"),
)
def _(spark, d):
    parts = F.split("sample_id", r"\|")
    weights = sample_weights(spark, d).select(F.get(parts, 0).cast("date").alias("date"), F.get(parts, 1).alias("asset"), "sample_weight")
    return _scaled(sw.attach_sample_weights(px(spark, d), weights), "sample_weight")
