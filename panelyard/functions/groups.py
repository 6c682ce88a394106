"""Group-wise primitives that hold when one group carries a large share of all rows.

A cross-section (all assets of one date) is the unit most operators work on, and there are
few dates, so ``Window.partitionBy("date")`` would put a whole market into one task. Every
primitive here has two physical strategies:

* *window*: used only when the caller passes ``max_group``, a measured upper bound of rows
  per group (``max_group_rows`` measures it once for many operators), and that bound is at
  most ``SPLIT_ROWS``;
* *split*: statistics are partial aggregates joined back to the rows, and orderings cut an
  oversized group into value ranges which are sorted by separate tasks and stitched
  together with the range offsets. Results are the same, no row is dropped or sampled.

Windows along time (``partitionBy("asset").orderBy("date")``) need no splitting: the table
contract makes (date, asset) unique, so an asset has at most one row per calendar date.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.storage import materialize

SPLIT_ROWS = 2_000_000
#: rows of a measured side table, or cut values of all groups, up to which it is broadcast
BROADCAST_ROWS = 500_000
_SALTS = 64
#: cut values in one array that rows carry while their range is searched
CUTS = 256
#: rows that a task of a dealt table sorts or groups
TASK_ROWS = 500_000


def max_group_rows(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: one partial aggregate, one number to the driver."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()
    return int(row["m"] or 0)


def fits(max_group: int | None, split_rows: int | None = None) -> bool:
    """Whether a measured group bound allows one task per group."""
    return max_group is not None and max_group <= (SPLIT_ROWS if split_rows is None else split_rows)


def dealt(df: DataFrame, keys: Sequence[str], rows: int | None) -> DataFrame:
    """Deal a table of ``rows`` rows (measured) by its keys over so many tasks that each gets about ``TASK_ROWS``.

    Adaptive execution sizes tasks by compressed bytes, and panels compress so well that a few tasks would hold all rows
    in their sorts; partitions asked for by number stay. Without a number of rows the table is left as it is.
    """
    if rows is None:
        return df
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, -(-rows // TASK_ROWS), min(slots, rows * 10 // TASK_ROWS)), *keys)


def _row_id(df: DataFrame, keys: Sequence[str], row_id: Sequence[str] | None) -> list[str]:
    """Columns that tell the rows of a group apart; without the usual ids, all columns but the keys.

    They only place the cuts and the salts, so rows that they don't tell apart are ranked right as well.
    """
    if row_id:
        return list(row_id)
    ids = [c for c in ("date", "asset", "factor") if c in df.columns and c not in keys]
    return ids or [c for c in df.columns if c not in keys] or list(keys)


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a per-group table back to its rows.

    A table keyed by a calendar DATE alone has at most one row per day (36 525 rows per
    century), which is a fixed bound, so it is broadcast. For any other key the join is left
    to adaptive execution, which broadcasts by measured size and splits skewed partitions.
    """
    calendar = list(keys) == ["date"] and isinstance(side.schema["date"].dataType, T.DateType)
    return df.join(F.broadcast(side) if calendar else side, list(keys), how)


def attach_small(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join a table with a row per date and bounded key (factor, fold) to a panel, without moving the panel on hot keys.

    The side is written and counted; up to ``BROADCAST_ROWS`` rows it is broadcast. Beyond, the join is adaptive: the
    written side lets a skewed key of the panel be split.
    """
    side = materialize(side)
    return df.join(F.broadcast(side) if side.count() <= BROADCAST_ROWS else side, list(keys), how)


def date_axis(df: DataFrame) -> DataFrame:
    """The distinct dates of a panel numbered from 1: columns date, t.

    Only the calendar (at most one row per day) passes through the single-task window, so the column must be a DATE.
    """
    if not isinstance(df.schema["date"].dataType, T.DateType):
        raise ValueError("date must be a DATE column")
    return (
        df.select("date").where(F.col("date").isNotNull()).distinct()
        .withColumn("t", F.row_number().over(W.orderBy("date")))
    )


def with_group_stats(
    df: DataFrame, keys: Sequence[str], stats: Mapping[str, Column], *, max_group: int | None = None
) -> DataFrame:
    """Add per-group aggregates to every row; ``stats`` are bare aggregate calls."""
    if fits(max_group):
        w = W.partitionBy(*keys)
        return df.withColumns({name: expr.over(w) for name, expr in stats.items()})
    side = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in stats.items()])
    return attach(df, side, keys)


def with_ranks(
    df: DataFrame,
    keys: Sequence[str],
    order: Column,
    *,
    minimum: str | None = None,
    average: str | None = None,
    dense: str | None = None,
    size: str | None = None,
    distinct: str | None = None,
    row_id: Sequence[str] | None = None,
    max_group: int | None = None,
    split_rows: int | None = None,
) -> DataFrame:
    """Rank rows inside each group, ascending by ``order``; NULL orders get NULL ranks.

    ``minimum``/``average``/``dense`` name the rank columns to add, ``size`` the number of
    ranked rows of the group and ``distinct`` the number of distinct orders. A row number is
    the ``minimum`` rank of a struct that ends in a tie-breaking key.
    """
    names = dict(minimum=minimum, average=average, dense=dense, size=size, distinct=distinct)
    base = df.withColumn("__rk_o", order)
    limit = split_rows if split_rows is not None else SPLIT_ROWS
    if fits(max_group, limit):
        return _rank_by_window(base, keys, names)
    base = materialize(base)
    hot = (
        base.where(F.col("__rk_o").isNotNull()).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    )
    if hot.isEmpty():
        return _rank_by_window(base, keys, names)
    return _rank_by_ranges(base, keys, names, hot, _row_id(df, keys, row_id), limit)


def _rank_by_window(base: DataFrame, keys: Sequence[str], names: Mapping[str, str | None]) -> DataFrame:
    # Unranked rows sort first, by the default null ordering, and their number is subtracted.
    # The last rank of a tie is a running count with peers, so ranks, ties and sizes share one
    # exchange on the keys and one sort by (keys, order); ordered windows come first.
    ranked = F.col("__rk_o").isNotNull()
    group = W.partitionBy(*keys)
    ordered = group.orderBy("__rk_o")
    out = {}
    if names["minimum"] or names["average"]:
        out["__rk_r"] = F.rank().over(ordered)
    if names["average"]:
        out["__rk_l"] = F.count(F.lit(1)).over(ordered.rangeBetween(W.unboundedPreceding, W.currentRow))
    if names["dense"] or names["distinct"]:
        out["__rk_d"] = F.dense_rank().over(ordered)
    base = base.withColumns(out).withColumns({"__rk_n": F.count("__rk_o").over(group), "__rk_all": F.count(F.lit(1)).over(group)})
    skipped = F.col("__rk_all") - F.col("__rk_n")
    final = {}
    if names["minimum"]:
        final[names["minimum"]] = F.when(ranked, F.col("__rk_r") - skipped)
    if names["average"]:
        final[names["average"]] = F.when(ranked, (F.col("__rk_r") + F.col("__rk_l")) / F.lit(2.0) - skipped)
    dense = F.when(ranked, F.col("__rk_d") - F.least(skipped, F.lit(1)))
    if names["dense"]:
        final[names["dense"]] = dense
    if names["distinct"]:
        final[names["distinct"]] = F.max(dense).over(group)
    if names["size"]:
        final[names["size"]] = F.col("__rk_n")
    return base.withColumns(final).drop("__rk_o", "__rk_n", "__rk_all", "__rk_r", "__rk_l", "__rk_d")


def lower_bound(cuts: Column, value: Column) -> Column:
    """Number of cuts below ``value``: binary search over a sorted array, as many steps as its size asks for."""
    size = F.greatest(F.size(cuts), F.lit(0))
    powers = F.sequence(F.floor(F.log2(size + F.lit(1))).cast("int"), F.lit(0), F.lit(-1))
    return F.aggregate(
        powers,
        F.lit(0),
        lambda at, power: F.when(
            (at + F.call_function("shiftleft", F.lit(1), power) <= F.size(cuts))
            & (F.get(cuts, at + F.call_function("shiftleft", F.lit(1), power) - 1) < value),
            at + F.call_function("shiftleft", F.lit(1), power),
        ).otherwise(at),
    )


def _place(base: DataFrame, keys: Sequence[str], cuts: DataFrame, value: Column) -> DataFrame:
    """Add ``__rk_at``, the number of a group's cuts below the value (-1 without a value), and ``__rk_tied``, whether it is a cut.

    A row copies the array that it is searched in, so an array of all cuts would cost each row as much as its group is
    large. Beyond ``CUTS`` cuts a group, they are cut into blocks of about the square root of their number: a first
    search finds the block by the blocks' last cuts, a second one the place among the cuts of that block alone.
    """
    most, held = cuts.agg(F.max(F.size("__rk_cuts")), F.sum(F.size("__rk_cuts"))).first()
    known, tied = value.isNotNull(), F.coalesce(F.get("__rk_cuts", F.col("__rk_in")) == value, F.lit(False))
    if (most or 0) <= CUTS:
        rows = _beside(base, cuts, keys, held or 0).withColumn("__rk_in", F.when(known, lower_bound(F.col("__rk_cuts"), value)))
        return rows.withColumns({"__rk_tied": tied, "__rk_at": F.coalesce("__rk_in", F.lit(-1))}).drop("__rk_cuts", "__rk_in")
    width = math.isqrt(most)
    spots = F.sequence(F.lit(0), F.floor((F.size("__rk_cuts") - 1) / F.lit(width)).cast("int"))
    blocks = materialize(cuts.select(*keys, "__rk_cuts", F.posexplode(spots).alias("__rk_block", "__")).select(
        *keys, "__rk_block", F.slice("__rk_cuts", F.col("__rk_block") * width + 1, F.lit(width)).alias("__rk_cuts")
    ))
    last = F.struct("__rk_block", F.element_at("__rk_cuts", -1).alias("c"))
    tops = materialize(blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(last)).alias("t")).select(*keys, F.col("t.c").alias("__rk_tops")))
    rows = _beside(base, tops, keys, tops.agg(F.sum(F.size("__rk_tops"))).first()[0])
    rows = rows.withColumn("__rk_block", F.when(known, lower_bound(F.col("__rk_tops"), value))).drop("__rk_tops")
    rows = _beside(rows, blocks, [*keys, "__rk_block"], held).withColumn("__rk_in", lower_bound(F.col("__rk_cuts"), value))
    at = F.when(known, F.col("__rk_block") * width + F.col("__rk_in")).otherwise(F.lit(-1))
    # Counts of the ranges and the ranking read the places: they are written, so that the search runs once.
    return materialize(rows.withColumns({"__rk_tied": tied, "__rk_at": at}).drop("__rk_cuts", "__rk_block", "__rk_in"))


def _beside(rows: DataFrame, side: DataFrame, keys: Sequence[str], held: int) -> DataFrame:
    """Left join of a written table of cuts, broadcast up to ``BROADCAST_ROWS`` of its values."""
    return rows.join(F.broadcast(side) if held <= BROADCAST_ROWS else side, list(keys), "left")


def _rank_by_ranges(
    base: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, str | None],
    hot: DataFrame,
    row_id: Sequence[str],
    limit: int,
) -> DataFrame:
    """Rank oversized groups range by range.

    Cut values come from a hash sample of the rows of each oversized group (about four per
    ``limit`` rows; every row is still ranked). Values between two cuts form one range;
    values equal to a cut form a range of their own in which all rows tie, so it needs no
    sort and is salted over many tasks - a value held by a third of the rows is harmless.
    """
    value = F.col("__rk_o")
    share = F.greatest(F.lit(1).cast("long"), F.expr(f"{limit} div 4"))
    pick = F.pmod(F.xxhash64(*keys, *row_id), share) == 0
    cuts = (
        base.where(value.isNotNull()).join(hot, list(keys), "left_semi").where(pick)
        .groupBy(*keys).agg(F.array_sort(F.collect_set("__rk_o")).alias("__rk_cuts"))
    )
    rows = _place(base, keys, materialize(cuts), value)
    salt = F.pmod(F.xxhash64(*row_id), F.lit(_SALTS))
    rows = (
        rows.withColumn("__rk_code", F.when(F.col("__rk_at") < 0, F.lit(-1)).otherwise(F.col("__rk_at") * 2 + F.col("__rk_tied").cast("int")))
        .withColumn("__rk_salt", F.when(F.col("__rk_tied") | value.isNull(), salt).otherwise(F.lit(0).cast("long")))
        .drop("__rk_at")
    )
    need_distinct = bool(names["dense"] or names["distinct"])
    counts = [F.count(F.lit(1)).alias("__rk_c")]
    if need_distinct:
        counts.append(F.count_distinct("__rk_o").alias("__rk_u"))
    ranges = rows.where(value.isNotNull()).groupBy(*keys, "__rk_code").agg(*counts)
    # One row per range: the cumulative window below sees ranges, not rows.
    below = W.partitionBy(*keys).orderBy("__rk_code").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    ranges = ranges.withColumns(
        {"__rk_below": F.coalesce(F.sum("__rk_c").over(below), F.lit(0)), "__rk_size": F.sum("__rk_c").over(whole)}
    )
    if need_distinct:
        ranges = ranges.withColumns(
            {"__rk_ubelow": F.coalesce(F.sum("__rk_u").over(below), F.lit(0)), "__rk_usize": F.sum("__rk_u").over(whole)}
        )
    rows = rows.join(ranges, [*keys, "__rk_code"], "left")
    inside = W.partitionBy(*keys, "__rk_code", "__rk_salt")
    ordered = inside.orderBy("__rk_o")
    ties = W.partitionBy(*keys, "__rk_code", "__rk_salt", "__rk_o")
    ranked, tied = value.isNotNull(), F.col("__rk_tied")
    out = {}
    first = F.when(tied, F.col("__rk_below") + 1).otherwise(F.col("__rk_below") + F.rank().over(ordered))
    if names["minimum"]:
        out[names["minimum"]] = F.when(ranked, first)
    if names["average"]:
        same = F.when(tied, F.col("__rk_c")).otherwise(F.count(F.lit(1)).over(ties))
        out[names["average"]] = F.when(ranked, first + (same - 1) / F.lit(2.0))
    if names["dense"]:
        step = F.when(tied, F.lit(1)).otherwise(F.dense_rank().over(ordered))
        out[names["dense"]] = F.when(ranked, F.col("__rk_ubelow") + step)
    rows = rows.withColumns(out)
    totals = {}
    if names["size"]:
        totals[names["size"]] = F.max("__rk_size")
    if names["distinct"]:
        totals[names["distinct"]] = F.max("__rk_usize")
    if totals:
        # Unranked rows of a group carry the group totals too.
        side = ranges.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()])
        rows = attach(rows, side, keys)
        if names["size"]:
            rows = rows.withColumn(names["size"], F.coalesce(F.col(names["size"]), F.lit(0)))
    return rows.drop("__rk_o", "__rk_code", "__rk_salt", "__rk_tied", "__rk_c", "__rk_u", "__rk_below", "__rk_ubelow", "__rk_size", "__rk_usize")


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Sequence[float],
    names: Sequence[str],
    *,
    row_id: Sequence[str] | None = None,
    max_group: int | None = None,
    split_rows: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one row per group; the same on either path.

    NaN counts as missing. Between equal neighbours, infinite ones too, the value is theirs; between -inf and +inf it
    is NULL.
    """
    value = F.when(~F.isnan(value.cast("double")), value.cast("double"))

    def known(q: Column) -> Column:
        return F.when(~F.isnan(q), q)

    if fits(max_group, split_rows):
        return df.groupBy(*keys).agg(
            *[known(F.percentile(value, F.lit(float(p)))).alias(n) for p, n in zip(probs, names, strict=True)]
        )
    ids = [c for c in _row_id(df, keys, row_id) if c not in keys]
    base = df.select(*keys, *ids, value.alias("__v"))
    ranked = with_ranks(
        base, keys, F.col("__v"), minimum="__r", size="__m", row_id=[*ids, "__v"], max_group=max_group, split_rows=split_rows
    )
    # The value at a position is the largest whose first rank isn't beyond it, so ties need no tie-breaker.
    aggs = []
    for p, n in zip(probs, names, strict=True):
        spot = (F.col("__m") - 1) * F.lit(float(p))
        low = F.max(F.when(F.col("__r") - 1 <= F.floor(spot), F.col("__v")))
        high = F.max(F.when(F.col("__r") - 1 <= F.ceil(spot), F.col("__v")))
        rest, part = F.max(F.ceil(spot) - spot), F.max(spot - F.floor(spot))
        aggs.append(known(F.when(low == high, low).otherwise(rest * low + part * high)).alias(n))
    return ranked.groupBy(*keys).agg(*aggs)
