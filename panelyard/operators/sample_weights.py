"""Sample weights from event concurrency, return size, age and label confidence.

Each function adds one normalized weight column (non-negative, summing to 1; uniform when
the total is not positive). Totals are one-row scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.columns import clean
from panelyard.functions.groups import group_quantiles
from panelyard.functions.storage import materialize
from panelyard.operators.splits import interval_rules, prepare_intervals
from panelyard.sources.contracts import require_columns, require_rules


def _normalized(df: DataFrame, *columns: str) -> DataFrame:
    """Scale columns to sum 1; one aggregate finds the totals of all of them."""
    size = {c: F.greatest(F.coalesce(clean(c), F.lit(0.0)), F.lit(0.0)) for c in columns}
    totals = df.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(w).alias(c) for c, w in size.items()])).scalar()
    t = F.col("__t")
    return df.withColumn("__t", totals).withColumns(
        {c: F.when(t[c] > 0, F.try_divide(w, t[c])).otherwise(F.lit(1.0) / t["n"]) for c, w in size.items()}
    ).drop("__t")


def _days(events: DataFrame) -> DataFrame:
    """Every calendar day between the first start and the last end."""
    span = events.agg(F.min("event_start").alias("a"), F.max("event_end").alias("z")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "z", F.expr("interval 1 day"))).alias("date"))


def _daily(events: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """One row per day: running number of active events, and whether it is a calendar date.

    A sweep: +1 on each start, -1 on the day after each end, pre-aggregated per day. The
    running sum sees days, never events x days.
    """
    steps = events.select(
        F.inline(
            F.array(
                F.struct(F.col("event_start").alias("date"), F.lit(1).alias("d")),
                F.struct(F.date_add("event_end", 1).alias("date"), F.lit(-1).alias("d")),
            )
        )
    ).groupBy("date").agg(F.sum("d").alias("d"))
    if calendar is None:
        days = _days(events).withColumn("__cal", F.weekday("date") < 5)
    else:
        days = calendar.select(F.col("date").cast("date").alias("date")).distinct().withColumn("__cal", F.lit(True))
        days = days.join(_days(events), "date", "full_outer")
    days = days.join(steps, "date", "full_outer")
    return days.select(
        "date", F.coalesce("__cal", F.lit(False)).alias("__cal"),
        F.sum(F.coalesce("d", F.lit(0))).over(W.orderBy("date")).cast("double").alias("concurrency"),
    )


def concurrency_by_date(
    events: DataFrame, *, start_col: str = "event_start", end_col: str = "event_end", calendar: DataFrame | None = None
) -> DataFrame:
    """Active events per calendar date; the default calendar is Monday to Friday."""
    frame = prepare_intervals(events, decision_col=start_col, start_col=start_col, end_col=end_col)
    return _daily(frame, calendar).where("__cal").select("date", "concurrency")


def uniqueness_weights(
    events: DataFrame, *, start_col: str = "event_start", end_col: str = "event_end", calendar: DataFrame | None = None,
    output_col: str = "weight_uniqueness",
) -> DataFrame:
    out = _uniqueness(events, start_col=start_col, end_col=end_col, calendar=calendar, output_col=output_col)
    return _normalized(out, output_col)


def _uniqueness(events: DataFrame, *, start_col: str, end_col: str, calendar: DataFrame | None, output_col: str) -> DataFrame:
    """Mean of 1/concurrency over an event's active calendar dates (0 without one).

    Prefix sums over days turn the mean into two look-ups per event.
    """
    frame = prepare_intervals(events, decision_col=start_col, start_col=start_col, end_col=end_col)
    up_to = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    inverse = F.when(F.col("__cal") & (F.col("concurrency") > 0), F.lit(1.0) / F.col("concurrency")).otherwise(F.lit(0.0))
    prefix = _daily(frame, calendar).select(
        "date", F.sum(inverse).over(up_to).alias("p"), F.sum(F.col("__cal").cast("int")).over(up_to).alias("k")
    )
    # One row per calendar day, so both look-ups are broadcast.
    upper = prefix.select(F.col("date").alias("event_end"), F.col("p").alias("__p1"), F.col("k").alias("__k1"))
    lower = prefix.select(F.date_add("date", 1).alias("event_start"), F.col("p").alias("__p0"), F.col("k").alias("__k0"))
    joined = frame.join(F.broadcast(upper), "event_end", "left").join(F.broadcast(lower), "event_start", "left")
    days = F.col("__k1") - F.coalesce("__k0", F.lit(0))
    mean = F.try_divide(F.col("__p1") - F.coalesce("__p0", F.lit(0.0)), days.cast("double"))
    out = joined.withColumn(output_col, F.coalesce(F.when(days > 0, mean), F.lit(0.0)))
    return out.select(*events.columns, output_col)


def return_magnitude_weights(
    df: DataFrame, *, return_col: str, row_id: Sequence[str] = ("sample_id",), clip_quantile: float = 0.99,
    output_col: str = "weight_return_magnitude", max_group: int | None = None,
) -> DataFrame:
    """Absolute return clipped at a quantile of the whole column; a missing return weighs 0."""
    return _normalized(_return_magnitude(df, return_col, row_id, clip_quantile, output_col, max_group), output_col)


def _return_magnitude(
    df: DataFrame, return_col: str, row_id: Sequence[str], clip_quantile: float, output_col: str, max_group: int | None, source: DataFrame | None = None
) -> DataFrame:
    if not 0 < clip_quantile <= 1:
        raise ValueError("clip_quantile must be in (0, 1]")
    size = F.abs(clean(return_col))
    cap = group_quantiles(
        (df if source is None else source).withColumn("__all", F.lit(1)), ["__all"], size, (clip_quantile,), ("q",), row_id=row_id, max_group=max_group
    ).select("q").scalar()
    clipped = F.when(F.col("__q") > 0, F.least(size, F.col("__q"))).otherwise(size)
    # least() skips NULL, so a missing return is set to 0 first.
    weight = F.when(size.isNull(), F.lit(0.0)).otherwise(clipped)
    return df.withColumn("__q", cap).withColumn(output_col, weight).drop("__q")


def time_decay_weights(
    df: DataFrame, *, date_col: str = "date", half_life_periods: float, reference_date: str | None = None, output_col: str = "weight_time_decay"
) -> DataFrame:
    """2^(-age / half-life), age counted in distinct dates back from the last (or reference) one."""
    return _normalized(_time_decay(df, date_col, half_life_periods, reference_date, output_col), output_col)


def _time_decay(df: DataFrame, date_col: str, half_life_periods: float, reference_date: str | None, output_col: str) -> DataFrame:
    if half_life_periods <= 0:
        raise ValueError("half_life_periods must be > 0")
    if not isinstance(df.schema[date_col].dataType, T.DateType):
        raise ValueError(f"{date_col} must be a DATE column")  # the calendar bounds the broadcast below
    dates = df.select(date_col).distinct().withColumn("__k", F.row_number().over(W.orderBy(date_col)) - 1)
    if reference_date is None:
        top = F.max("__k")
    else:
        top = F.coalesce(F.max(F.when(F.col(date_col) <= F.lit(reference_date).cast("date"), F.col("__k"))), F.lit(0))
    dates = dates.withColumn("__top", dates.agg(top).scalar())
    age = F.greatest(F.col("__top") - F.col("__k"), F.lit(0)).cast("double")
    weight = F.pow(F.lit(2.0), -age / F.lit(float(half_life_periods)))
    return df.join(F.broadcast(dates.select(date_col, weight.alias(output_col))), date_col)


def confidence_weights(
    df: DataFrame, *, confidence_col: str, min_weight: float = 0.1, max_weight: float = 1.0, output_col: str = "weight_confidence"
) -> DataFrame:
    """Confidence scaled to [min_weight, max_weight]; a constant column scales to 1, NULL to the minimum."""
    return _normalized(_confidence(df, confidence_col, min_weight, max_weight, output_col), output_col)


def _confidence(
    df: DataFrame, confidence_col: str, min_weight: float, max_weight: float, output_col: str, source: DataFrame | None = None
) -> DataFrame:
    if min_weight < 0:
        raise ValueError("min_weight must be >= 0")
    if max_weight <= min_weight:
        raise ValueError("max_weight must be > min_weight")
    c = clean(confidence_col)
    ends = (df if source is None else source).agg(F.struct(F.coalesce(F.min(c), F.lit(0.0)).alias("lo"), F.coalesce(F.max(c), F.lit(0.0)).alias("hi"))).scalar()
    lo, hi = F.col("__e.lo"), F.col("__e.hi")
    # Absolute and relative tolerance of "constant".
    constant = hi - lo <= F.lit(1e-8) + F.lit(1e-5) * F.abs(lo)
    scaled = F.when(constant, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(c - lo, hi - lo), F.lit(0.0)))
    weight = F.lit(float(min_weight)) + F.lit(float(max_weight - min_weight)) * scaled
    return df.withColumn("__e", ends).withColumn(output_col, weight).drop("__e")


def combine_weight_components(
    df: DataFrame, components: Sequence[str], *, normalize: bool = True, output_col: str = "sample_weight", validate: bool = True
) -> DataFrame:
    """Product of the components; a missing component counts as 1, a negative one raises unless ``validate`` is off."""
    if not components:
        raise ValueError("components must be non-empty")
    if validate:
        require_rules(df, {f"negative_{c}": clean(c) < 0 for c in components}, "weight components")
    product: Column = F.lit(1.0)
    for c in components:
        product = product * F.coalesce(clean(c), F.lit(1.0))
    out = df.withColumn(output_col, product)
    return _normalized(out, output_col) if normalize else out


def build_sample_weights(
    events: DataFrame, *, sample_id_col: str = "sample_id", decision_col: str = "date", start_col: str = "event_start", end_col: str = "event_end",
    return_col: str | None = None, confidence_col: str | None = None, half_life_periods: float | None = None, calendar: DataFrame | None = None,
    max_group: int | None = None, validate: bool = True,
) -> DataFrame:
    """All requested components and their normalized product, one row per sample.

    Missing or inverted intervals and repeated sample ids raise, unless ``validate`` is off. Events and raw components are each written once: the totals read them again.
    """
    require_columns(events, (sample_id_col,), "events")
    frame = prepare_intervals(events, decision_col=decision_col, start_col=start_col, end_col=end_col)
    kept = list(dict.fromkeys(c for c in (return_col, confidence_col) if c))
    base = [sample_id_col, "decision_date", "event_start", "event_end"]
    frame = materialize(frame.select(*base, *kept))
    if validate:
        require_rules(frame, interval_rules(), "events", (sample_id_col,))
    out = _uniqueness(frame, start_col="event_start", end_col="event_end", calendar=calendar, output_col="weight_uniqueness")
    parts = ["weight_uniqueness"]
    if return_col is not None:
        parts.append("weight_return_magnitude")
        out = _return_magnitude(out, return_col, (sample_id_col,), 0.99, parts[-1], max_group, source=frame)
    if confidence_col is not None:
        parts.append("weight_confidence")
        out = _confidence(out, confidence_col, 0.1, 1.0, parts[-1], source=frame)
    if half_life_periods is not None:
        parts.append("weight_time_decay")
        out = _time_decay(out, "decision_date", half_life_periods, None, parts[-1])
    raw = materialize(out.select(*base, *parts))
    return combine_weight_components(_normalized(raw, *parts), parts, validate=False).select(*base, *parts, "sample_weight")


def attach_sample_weights(keys: DataFrame, sample_weights: DataFrame) -> DataFrame:
    """Weights on the distinct (date, asset) keys of a table; keys without a weight keep NULL."""
    require_columns(sample_weights, ("date", "asset", "sample_weight"), "sample_weights")
    return keys.select("date", "asset").distinct().join(
        sample_weights.select("date", "asset", clean("sample_weight").alias("sample_weight")), ["date", "asset"], "left"
    )
