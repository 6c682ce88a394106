"""Validation splits and sample weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyard.catalog.panels import cte, events_iv, px, sql_with
from panelyard.catalog.registry import query
from panelyard.functions.columns import rounded
from panelyard.operators import splits


@query(
    "time_split",
    sql_with(
        "px",
        "SELECT date, asset, CASE WHEN date <= date '1997-06-30' THEN 'train' WHEN date >= date '1999-01-01' THEN 'test' WHEN date >= date '1998-01-01' THEN 'val' END AS split FROM px",
    ),
)
def _(spark, d):
    out = splits.time_split(px(spark, d), train_end="1997-06-30", val_start="1998-01-01", test_start="1999-01-01")
    return out.select("date", "asset", "split")


def wf_ctes(name: str, train: int, test: int, step: int, val: int) -> None:
    cte(
        name, "dates",
        f"""SELECT cast(k as integer) AS fold_id, date, CASE WHEN t - 1 - k * {step} < {train - val} THEN 'train' WHEN t - 1 - k * {step} < {train} THEN 'val' ELSE 'test' END AS role
        FROM dates JOIN (SELECT unnest(range(0, (SELECT (max(t) - {train + test}) // {step} + 1 FROM dates))) AS k) ON t - 1 >= k * {step} AND t - 1 < k * {step} + {train + test}""",
    )


WF = dict(train_size=24, test_size=9, step=6, val_size=4)
wf_ctes("wf", 24, 9, 6, 4)


@query("walk_forward_split", sql_with("wf", "SELECT * FROM wf"))
def _(spark, d):
    return splits.walk_forward_split(px(spark, d), **WF)


cte(
    "wfw", "wf",
    """SELECT fold_id, min(date) FILTER (role = 'train') AS train_start, max(date) FILTER (role = 'train') AS train_end, min(date) FILTER (role = 'val') AS val_start,
    max(date) FILTER (role = 'val') AS val_end, min(date) FILTER (role = 'test') AS test_start, max(date) FILTER (role = 'test') AS test_end FROM wf GROUP BY fold_id""",
)


@query("fold_windows", sql_with("wfw", "SELECT * FROM wfw"))
def _(spark, d):
    return splits.fold_windows(splits.walk_forward_split(px(spark, d), **WF))


cte("iv", "events_iv", "SELECT sample_id, asset, date AS decision_date, event_start, event_end, v FROM events_iv WHERE event_end IS NOT NULL")


def intervals(spark, d):
    return events_iv(spark, d).where(F.col("event_end").isNotNull())


@query(
    "interval_contract",
    sql_with(
        "events_iv",
        """SELECT rule, n FROM (SELECT cast(count(*) = 0 as bigint) AS empty_table, count(*) FILTER (date IS NULL) AS invalid_decision_date, count(*) FILTER (event_start IS NULL OR event_end IS NULL) AS invalid_interval,
        count(*) FILTER (event_end < event_start) AS end_before_start FROM events_iv) UNPIVOT (n FOR rule IN (empty_table, invalid_decision_date, invalid_interval, end_before_start))""",
    ),
)
def _(spark, d):
    return splits.interval_violations(splits.prepare_intervals(events_iv(spark, d)))


_MERGE = """SELECT {k} min(event_start) AS event_start, max(event_end) AS event_end FROM (SELECT *, sum(new) OVER (PARTITION BY {p} ORDER BY event_start, event_end, sample_id ROWS UNBOUNDED PRECEDING) AS island FROM (
 SELECT *, CASE WHEN event_start <= max(event_end) OVER (PARTITION BY {p} ORDER BY event_start, event_end, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {s})) GROUP BY {k} island"""


@query("merged_intervals", sql_with("iv", "SELECT asset, event_start, event_end FROM (" + _MERGE.format(k="asset,", p="asset", s="iv") + ")"))
def _(spark, d):
    return splits.merge_intervals(intervals(spark, d), ["asset"])


@query(
    "overlapping_samples",
    sql_with(
        "iv",
        """SELECT sample_id FROM iv s WHERE EXISTS (SELECT 1 FROM iv t WHERE t.decision_date BETWEEN date '1997-03-01' AND date '1997-09-30'
        AND s.event_start <= t.event_end AND t.event_start <= s.event_end)""",
    ),
)
def _(spark, d):
    iv = intervals(spark, d)
    test = iv.where(F.col("date").between(F.lit("1997-03-01").cast("date"), F.lit("1997-09-30").cast("date")))
    return splits.overlapping(iv, test).select("sample_id")


def purge_ctes(name: str, combos: list[tuple[int, ...]], groups: int, embargo: int, iv: str = "iv") -> None:
    listed = ", ".join(f"({f}, {g})" for f, combo in enumerate(combos) for g in combo)
    cte(
        f"{name}_axis", iv,
        f"""SELECT decision_date, t, CASE WHEN t - 1 < r * (q + 1) THEN (t - 1) // (q + 1) ELSE r + (t - 1 - r * (q + 1)) // q END AS g FROM (
        SELECT decision_date, row_number() OVER (ORDER BY decision_date) AS t, count(*) OVER () // {groups} AS q, count(*) OVER () % {groups} AS r FROM (SELECT DISTINCT decision_date FROM {iv}))""",
    )
    cte(f"{name}_combo", "", f"SELECT * FROM (VALUES {listed}) AS c(fold_id, g)")
    cte(
        f"{name}_fold", f"{iv} {name}_axis {name}_combo",
        f"SELECT c.fold_id, i.event_start, i.event_end, a.t FROM {iv} i JOIN {name}_axis a ON i.decision_date = a.decision_date JOIN {name}_combo c ON a.g = c.g",
    )
    cte(f"{name}_span", f"{name}_fold", f"SELECT fold_id, event_start, max(event_end) AS event_end FROM {name}_fold GROUP BY 1, 2")
    cte(
        name, f"{iv} {name}_axis {name}_combo {name}_fold {name}_span",
        f"""SELECT f.fold_id, i.sample_id, i.decision_date, CASE WHEN c.g IS NOT NULL THEN 'test'
        WHEN EXISTS (SELECT 1 FROM {name}_span s WHERE s.fold_id = f.fold_id AND s.event_start <= i.event_end AND i.event_start <= s.event_end) THEN 'purged'
        WHEN a.t > last_t AND a.t <= last_t + {embargo} THEN 'embargoed' ELSE 'train' END AS role
        FROM {iv} i JOIN {name}_axis a ON i.decision_date = a.decision_date CROSS JOIN (SELECT fold_id, max(t) AS last_t FROM {name}_fold GROUP BY 1) f
        LEFT JOIN {name}_combo c ON c.fold_id = f.fold_id AND c.g = a.g""",
    )


from itertools import combinations  # noqa: E402

purge_ctes("pkf", [(g,) for g in range(5)], 5, 4)
purge_ctes("cpkf", list(combinations(range(5), 2)), 5, 4)
_ROLES = """SELECT fold_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) FILTER (role = 'purged') AS n_purged,
 count(*) FILTER (role = 'embargoed') AS n_embargoed, min(decision_date) FILTER (role = 'test') AS test_start, max(decision_date) FILTER (role = 'test') AS test_end FROM {s} GROUP BY fold_id"""


@query("purged_kfold_split", sql_with("pkf", "SELECT fold_id, sample_id, role FROM pkf"))
def _(spark, d):
    return splits.purged_kfold_split(intervals(spark, d), n_splits=5, embargo_periods=4).select("fold_id", "sample_id", "role")


@query("combinatorial_purged_split", sql_with("cpkf", "SELECT fold_id, sample_id, role FROM cpkf"))
def _(spark, d):
    out = splits.combinatorial_purged_split(intervals(spark, d), n_groups=5, n_test_groups=2, embargo_periods=4)
    return out.select("fold_id", "sample_id", "role")


@query("purged_fold_summary", sql_with("pkf", _ROLES.format(s="pkf")))
def _(spark, d):
    return splits.purged_validation_summary(intervals(spark, d), n_splits=5, embargo_periods=4)
