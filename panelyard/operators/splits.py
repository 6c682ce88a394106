"""Validation splits as tables: a fold is a column, never a loop.

Dates are numbered on the panel's distinct date axis (at most one row per calendar day) and
every fold boundary is arithmetic on that number.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.groups import attach_small, date_axis, lower_bound
from panelyard.functions.storage import materialize
from panelyard.sources.contracts import require_columns, rule_counts


def time_split(df: DataFrame, *, train_end: str, test_start: str, val_start: str | None = None) -> DataFrame:
    """Add ``split`` (train, val, test); dates in the gaps belong to no split."""
    if train_end >= test_start:
        raise ValueError("train_end must be strictly before test_start")
    if val_start is not None and not train_end < val_start <= test_start:
        raise ValueError("val_start must be after train_end and at or before test_start")
    d = F.col("date")
    role = F.when(d <= F.lit(train_end).cast("date"), "train").when(d >= F.lit(test_start).cast("date"), "test")
    if val_start is not None:
        role = role.when(d >= F.lit(val_start).cast("date"), "val")
    return df.withColumn("split", role)


def walk_forward_split(dates: DataFrame, *, train_size: int, test_size: int, step: int, val_size: int = 0) -> DataFrame:
    """(fold_id, date, role) over the distinct dates of ``dates``; val is the tail of train.

    The folds of a date follow from its number, so dates are exploded, not range-joined.
    """
    if train_size <= 0 or test_size <= 0 or step <= 0:
        raise ValueError("train_size, test_size, and step must be positive integers")
    if not 0 <= val_size < train_size:
        raise ValueError("val_size must be non-negative and less than train_size")
    span = train_size + test_size
    axis = date_axis(dates)
    n = axis.agg(F.coalesce(F.max("t"), F.lit(0))).scalar()
    axis = axis.withColumns({"__p": F.col("t") - 1, "__n": n}).where(F.col("__n") >= span)
    first = F.expr(f"if(__p >= {span}, (__p - {span}) div {step} + 1, 0)")
    last = F.least(F.expr(f"__p div {step}"), F.expr(f"(__n - {span}) div {step}"))
    rows = axis.withColumns({"__a": first.cast("int"), "__z": last.cast("int")}).where("__a <= __z").select(
        "date", "__p", F.explode(F.sequence("__a", "__z")).alias("fold_id")
    )
    at = F.col("__p") - F.col("fold_id") * step
    role = F.when(at < train_size - val_size, "train").when(at < train_size, "val").otherwise("test")
    return rows.select("fold_id", "date", role.alias("role"))


def fold_windows(folds: DataFrame) -> DataFrame:
    """First and last date of each role per fold."""

    def edge(fn, role: str):
        return fn(F.when(F.col("role") == role, F.col("date")))

    return folds.groupBy("fold_id").agg(
        edge(F.min, "train").alias("train_start"), edge(F.max, "train").alias("train_end"),
        edge(F.min, "val").alias("val_start"), edge(F.max, "val").alias("val_end"),
        edge(F.min, "test").alias("test_start"), edge(F.max, "test").alias("test_end"),
    )


def prepare_intervals(samples: DataFrame, *, decision_col: str = "date", start_col: str = "event_start", end_col: str = "event_end") -> DataFrame:
    """Add decision_date, event_start and event_end; absent interval columns are the decision date.

    Intervals are calendar dates: that bounds every table of merged intervals by the calendar.
    """
    require_columns(samples, (decision_col,), "samples")
    start = F.col(start_col if start_col in samples.columns else decision_col)
    end = F.col(end_col if end_col in samples.columns else decision_col)
    out = samples.withColumns({"decision_date": F.col(decision_col), "event_start": start, "event_end": end})
    for c in ("decision_date", "event_start", "event_end"):
        if not isinstance(out.schema[c].dataType, T.DateType):
            raise ValueError(f"{c} must be a DATE column")
    return out


def interval_rules() -> dict[str, Column]:
    return {
        "invalid_decision_date": F.col("decision_date").isNull(),
        "invalid_interval": F.col("event_start").isNull() | F.col("event_end").isNull(),
        "end_before_start": F.col("event_end") < F.col("event_start"),
    }


def interval_violations(prepared: DataFrame) -> DataFrame:
    return rule_counts(prepared, interval_rules())


def merge_intervals(intervals: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Union of closed date intervals per key, as disjoint (event_start, event_end) rows.

    Intervals first collapse to one row per key and start date (a partial aggregate), so the
    gaps-and-islands window runs over calendar days, not over samples.
    """
    days = intervals.groupBy(*keys, "event_start").agg(F.max("event_end").alias("event_end"))
    ordered = W.partitionBy(*keys).orderBy("event_start")
    reach = F.max("event_end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opened = F.when(reach.isNull() | (F.col("event_start") > reach), 1).otherwise(0)
    islands = days.withColumn("__new", opened).withColumn("__island", F.sum("__new").over(ordered))
    return islands.groupBy(*keys, "__island").agg(
        F.min("event_start").alias("event_start"), F.max("event_end").alias("event_end")
    ).drop("__island")


def _as_arrays(merged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Disjoint intervals per key as two sorted arrays (at most one entry per calendar day)."""
    spans = F.array_sort(F.collect_list(F.struct("event_start", "event_end")))
    return merged.groupBy(*keys).agg(spans.alias("__i")).select(
        *keys, F.col("__i.event_start").alias("starts"), F.col("__i.event_end").alias("ends")
    )


def _overlaps(starts, ends):
    """Closed-interval overlap of the row's event with sorted disjoint intervals, by binary search."""
    at = lower_bound(starts, F.date_add("event_end", 1))
    return (at > 0) & F.coalesce(F.get(ends, at - 1) >= F.col("event_start"), F.lit(False))


def overlapping(samples: DataFrame, test_samples: DataFrame) -> DataFrame:
    """Samples whose interval overlaps any test interval (a semi join on ranges)."""
    merged = _as_arrays(merge_intervals(test_samples.select("event_start", "event_end"))).select(F.struct("starts", "ends"))
    out = samples.withColumn("__m", merged.scalar())
    return out.where(F.col("__m").isNotNull() & _overlaps(F.col("__m.starts"), F.col("__m.ends"))).drop("__m")


#: test blocks that one word of a bit set tells apart
_WORD = 62


def _bits(groups: Sequence[int], n_groups: int) -> list[int]:
    """Groups as a bit set of words."""
    words = [0] * (-(-n_groups // _WORD))
    for g in groups:
        words[g // _WORD] |= 1 << g % _WORD
    return words


def _meet(a: Column, b: Column) -> Column:
    return F.exists(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w: w != 0)


def _dated_blocks(frame: DataFrame, n_groups: int, validate: bool) -> tuple[DataFrame, list[int]]:
    """(decision_date, t, __g): dates numbered and dealt into contiguous blocks, as even as possible; the last number of each block.

    One pass over the samples, to a row a date, finds the dates and what breaks a rule.
    """
    rules = interval_rules()
    per_date = materialize(frame.groupBy("decision_date").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]))
    axis = date_axis(per_date.select(F.col("decision_date").alias("date")))
    if validate:
        found = per_date.agg(*[F.sum(n).alias(n) for n in rules]).first()
        broken = sorted((n, found[n]) for n in rules if found[n])
        if broken:
            raise ValueError("samples breaks its contract: " + ", ".join(f"{n}={k}" for n, k in broken))
    dates = axis.count()
    if validate and dates < n_groups:
        raise ValueError(f"{n_groups} folds need as many decision dates, got {dates}")
    q, r = divmod(dates, n_groups)  # the first r blocks hold one date more
    last = [min((g + 1) * q + min(g + 1, r), dates) for g in range(n_groups)]
    p = "(t - 1)"
    block = F.expr(f"if({p} < {r} * ({q} + 1), {p} div ({q} + 1), {r} + ({p} - {r} * ({q} + 1)) div greatest({q}, 1))")
    return axis.select(F.col("date").alias("decision_date"), "t", block.cast("int").alias("__g")), last


def _with_block_bits(samples: DataFrame, combos: Sequence[tuple[int, ...]], n_groups: int, validate: bool, interval_cols: dict) -> tuple[DataFrame, DataFrame, list[str]]:
    """Samples with t, their block __g and the bit set __met of blocks whose events they overlap; and the folds as bit sets.

    A fold tests some blocks, so a sample overlaps its test events just if it overlaps those of one of its blocks: a role
    in any number of folds follows from one bit set. The bits are found for the distinct pairs of event dates.
    """
    frame = prepare_intervals(samples, **interval_cols)
    axis, last = _dated_blocks(frame, n_groups, validate)
    rows = frame.join(F.broadcast(axis), "decision_date")
    days = rows.groupBy("__g", "event_start").agg(F.max("event_end").alias("event_end"))
    spans = _as_arrays(merge_intervals(days, ["__g"]), ["__g"])
    blocks = spans.agg(F.collect_list(F.struct("__g", "starts", "ends"))).scalar()  # a value of n_groups spans, for the pairs only
    events = rows.select("event_start", "event_end").distinct().withColumn("__blocks", blocks)

    def bits_of(word: int) -> Column:
        """Bits of the blocks of one word whose test events the row's event overlaps."""
        own = F.filter("__blocks", lambda b: F.floor(b["__g"] / _WORD) == word)
        bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b["__g"] % _WORD)
        return F.aggregate(own, F.lit(0).cast("long"), lambda bits, b: F.when(_overlaps(b["starts"], b["ends"]), bits.bitwiseOR(bit(b))).otherwise(bits))

    met = [bits_of(w) for w in range(-(-n_groups // _WORD))]
    masks = events.select("event_start", "event_end", F.array(*met).alias("__met"))
    folds = samples.sparkSession.createDataFrame(
        [(i, _bits(c, n_groups), max(last[g] for g in c)) for i, c in enumerate(combos)], "fold_id int, __tests array<long>, __last int"
    )
    return attach_small(rows, masks, ["event_start", "event_end"], "left"), folds, frame.columns


def _role(embargo_periods: int, n_groups: int) -> Column:
    own = F.array(*[F.when(F.floor(F.col("__g") / _WORD) == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__g") % _WORD)).otherwise(0) for w in range(-(-n_groups // _WORD))])
    after = F.col("t") - F.col("__last")
    return (
        F.when(_meet(own, F.col("__tests")), "test").when(F.coalesce(_meet(F.col("__met"), F.col("__tests")), F.lit(False)), "purged")
        .when((after > 0) & (after <= embargo_periods), "embargoed").otherwise("train")
    )


def _check_embargo(embargo_periods: int) -> None:
    if embargo_periods < 0:
        raise ValueError("embargo_periods must be >= 0")


def _purged(samples: DataFrame, combos: Sequence[tuple[int, ...]], n_groups: int, embargo_periods: int, validate: bool, interval_cols: dict) -> DataFrame:
    """A row for every fold and sample: the samples are repeated here, as asked for, and nowhere before."""
    _check_embargo(embargo_periods)
    rows, folds, columns = _with_block_bits(samples, combos, n_groups, validate, interval_cols)
    out = rows.crossJoin(F.broadcast(folds))  # a row a fold
    return out.select("fold_id", *columns, _role(embargo_periods, n_groups).alias("role"))


def _purged_counts(samples: DataFrame, combos: Sequence[tuple[int, ...]], n_groups: int, embargo_periods: int, validate: bool, interval_cols: dict) -> DataFrame:
    """``purged_fold_summary`` of all folds from counted bit sets: samples are counted by date and bits before any fold is looked at."""
    _check_embargo(embargo_periods)
    rows, folds, _ = _with_block_bits(samples, combos, n_groups, validate, interval_cols)
    counted = rows.groupBy("decision_date", "t", "__g", "__met").agg(F.count(F.lit(1)).alias("__k"))
    by_role = counted.crossJoin(F.broadcast(folds)).select("fold_id", "decision_date", "__k", _role(embargo_periods, n_groups).alias("role"))
    total = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("__k"))), F.lit(0)).cast("long")
    test_date = F.when(F.col("role") == "test", F.col("decision_date"))
    return by_role.groupBy("fold_id").agg(
        total("train").alias("n_train"), total("test").alias("n_test"), total("purged").alias("n_purged"), total("embargoed").alias("n_embargoed"),
        F.min(test_date).alias("test_start"), F.max(test_date).alias("test_end"),
    )


def purged_kfold_split(samples: DataFrame, *, n_splits: int, embargo_periods: int = 0, validate: bool = True, **interval_cols) -> DataFrame:
    """Every (fold, sample) with its role: test, purged, embargoed or train.

    Missing or inverted intervals and fewer dates than folds raise, unless ``validate`` is off.
    """
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    return _purged(samples, [(g,) for g in range(n_splits)], n_splits, embargo_periods, validate, interval_cols)


def combinatorial_purged_split(samples: DataFrame, *, n_groups: int, n_test_groups: int, embargo_periods: int = 0, validate: bool = True, **interval_cols) -> DataFrame:
    """As the purged K-fold, one fold per combination of test blocks; the embargo follows the last test date."""
    _check_groups(n_groups, n_test_groups)
    return _purged(samples, list(combinations(range(n_groups), n_test_groups)), n_groups, embargo_periods, validate, interval_cols)


def purged_fold_summary(splits: DataFrame) -> DataFrame:
    role = F.col("role")
    test_date = F.when(role == "test", F.col("decision_date"))
    return splits.groupBy("fold_id").agg(
        F.count_if(role == "train").alias("n_train"),
        F.count_if(role == "test").alias("n_test"),
        F.count_if(role == "purged").alias("n_purged"),
        F.count_if(role == "embargoed").alias("n_embargoed"),
        F.min(test_date).alias("test_start"),
        F.max(test_date).alias("test_end"),
    )


def purged_validation_summary(samples: DataFrame, *, n_splits: int, embargo_periods: int = 0, validate: bool = True, **interval_cols) -> DataFrame:
    """Sizes and test dates of the purged folds; the samples aren't repeated."""
    if n_splits < 2:
        raise ValueError("n_splits must be >= 2")
    return _purged_counts(samples, [(g,) for g in range(n_splits)], n_splits, embargo_periods, validate, interval_cols)


def combinatorial_validation_summary(samples: DataFrame, *, n_groups: int, n_test_groups: int, embargo_periods: int = 0, validate: bool = True, **interval_cols) -> DataFrame:
    """Sizes and test dates of all combinatorial folds; the samples aren't repeated."""
    _check_groups(n_groups, n_test_groups)
    return _purged_counts(samples, list(combinations(range(n_groups), n_test_groups)), n_groups, embargo_periods, validate, interval_cols)


def _check_groups(n_groups: int, n_test_groups: int) -> None:
    if n_groups < 2:
        raise ValueError("n_groups must be >= 2")
    if not 0 < n_test_groups < n_groups:
        raise ValueError("n_test_groups must be in [1, n_groups - 1]")


def with_fold(df: DataFrame, folds: DataFrame, role: str = "test", carry: Sequence[str] = ()) -> DataFrame:
    """Rows of a panel repeated for each fold whose ``role`` dates contain them, with columns of the fold table to carry.

    The fold table has one row per date and fold that overlaps it; it is written and counted before it is broadcast.
    """
    return attach_small(df, folds.where(F.col("role") == role).select("date", "fold_id", *carry), ["date"], "inner")
