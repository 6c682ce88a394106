"""Executable target weights under gross, net, cash and position limits."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, flag
from panelyard.functions.groups import with_group_stats, with_ranks

DATE = ("date",)


@dataclass(frozen=True)
class Construction:
    construction_method: str = "top_bottom_k"
    weight_method: str = "equal"
    top_k: int | None = None
    bottom_k: int | None = None
    long_short: bool = False
    gross_limit: float = 1.0
    net_limit: float = 1.0
    cash_buffer: float = 0.0
    min_weight: float | None = None
    max_weight: float = 1.0
    weight_clip: float | None = None
    trade_when_not_tradable: bool = False

    @property
    def intent_method(self) -> str:
        if self.construction_method == "top_bottom_k" and self.weight_method == "equal":
            return "rank_topbottom_equal" if self.long_short else "rank_topk_equal"
        if self.weight_method in ("rank", "score"):
            return "zscore_proportional"
        if self.construction_method == "full_universe" and self.weight_method == "equal" and not self.long_short:
            return "rank_topk_equal"
        raise ValueError(
            f"unsupported construction: {self.construction_method!r}, {self.weight_method!r}, long_short={self.long_short!r}"
        )


def executable_mask(signal: DataFrame, universe: DataFrame, tradability: DataFrame, *, trade_when_not_tradable: bool = False) -> DataFrame:
    """Signal with both masks; executable = in universe, tradable (or overridden), signal present.

    The three tables meet one to one in a single exchange by (date, asset), which also counts: a key that is repeated in
    any of them raises when the result is computed.
    """
    columns = {"signal": (signal, clean("signal_value")), "universe": (universe, flag("in_universe")), "tradability": (tradability, flag("is_tradable"))}
    rows = reduce(DataFrame.unionByName, [
        df.select("date", "asset", *[(c if n == name else F.lit(None)).cast("double" if n == "signal" else "boolean").alias(n) for n, (_, c) in columns.items()], F.lit(name).alias("table"))
        for name, (df, _) in columns.items()
    ])
    counts = {f"n_{n}": F.count_if(F.col("table") == n) for n in columns}
    met = rows.where("date is not null and asset is not null").groupBy("date", "asset").agg(
        *[F.max(n).alias(n) for n in columns], *[c.alias(n) for n, c in counts.items()]
    )
    once = F.raise_error(F.concat(F.lit("signal, universe and tradability must be one to one, repeated: "), F.col("date").cast("string"), F.lit(" "), F.col("asset"))).cast("boolean")
    met = met.where(F.when(F.greatest(*counts) > 1, once).otherwise(F.least(*counts) == 1))
    tradable = F.lit(True) if trade_when_not_tradable else F.col("tradability")
    return met.select(
        "date", "asset", F.col("signal").alias("signal_value"), F.col("universe").alias("in_universe"), F.col("tradability").alias("is_tradable"),
        (F.col("universe") & tradable & F.col("signal").isNotNull()).alias("is_executable"),
    )


def _selected(df: DataFrame, pc: Construction, max_group: int | None) -> DataFrame:
    """Add __long and __short selections (ties by asset) and how many shorts were available."""
    run = F.col("is_executable")
    if pc.construction_method == "full_universe":
        return df.withColumns({"__long": run, "__short": F.lit(False), "__left": F.lit(0)})
    if pc.top_k is None or pc.top_k <= 0:
        raise ValueError("top_k must be a positive integer")
    down = F.when(run, F.struct((-F.col("signal_value")).alias("v"), F.col("asset")))
    df = with_ranks(df, DATE, down, minimum="__k", max_group=max_group)
    df = df.withColumn("__long", F.coalesce(F.col("__k") <= pc.top_k, F.lit(False))).drop("__k")
    if not pc.long_short:
        return df.withColumns({"__short": F.lit(False), "__left": F.lit(0)})
    if pc.bottom_k is None or pc.bottom_k <= 0:
        raise ValueError("bottom_k must be a positive integer")
    up = F.when(run & ~F.col("__long"), F.struct(F.col("signal_value").alias("v"), F.col("asset")))
    df = with_ranks(df, DATE, up, minimum="__k", size="__left", max_group=max_group)
    return df.withColumn("__short", F.coalesce(F.col("__k") <= pc.bottom_k, F.lit(False))).drop("__k")


def _raw(df: DataFrame, pc: Construction, max_group: int | None) -> DataFrame:
    run = F.col("is_executable")
    df = _selected(df, pc, max_group)
    if pc.intent_method != "zscore_proportional":
        stats = {"__nl": F.count_if("__long"), "__ns": F.count_if("__short")}
        df = with_group_stats(df, DATE, stats, max_group=max_group)
        weight = F.when(F.col("__long"), F.lit(1.0) / F.col("__nl")).when(F.col("__short"), F.lit(-1.0) / F.col("__ns")).otherwise(F.lit(0.0))
        return df.withColumns({"__w": weight, "__flat": F.lit(False)})
    s = F.when(run, F.col("signal_value"))
    stats = {"__mu": F.avg(s), "__sd": F.stddev_pop(s), "__lo": F.min(s), "__hi": F.max(s)}
    df = with_group_stats(df, DATE, stats, max_group=max_group)
    df = df.withColumn("__vary", F.coalesce(F.col("__lo") < F.col("__hi"), F.lit(False)))
    z = F.when(run & F.col("__vary"), F.try_divide(s - F.col("__mu"), F.col("__sd")))
    if pc.construction_method == "top_bottom_k":
        z = F.when(F.col("__long") | F.col("__short"), z)
    z = F.coalesce(z, F.lit(0.0))
    if not pc.long_short:
        z = F.greatest(z, F.lit(0.0))
    if pc.weight_clip is not None:
        z = F.greatest(F.least(z, F.lit(float(pc.weight_clip))), F.lit(-float(pc.weight_clip) if pc.long_short else 0.0))
    return df.withColumns({"__w": z, "__flat": ~F.col("__vary")})


def _constrained(df: DataFrame, pc: Construction, max_group: int | None) -> DataFrame:
    w: Column = F.col("__w")
    if not pc.long_short:
        w = F.greatest(w, F.lit(0.0))
    if pc.min_weight is not None:
        w = F.when(F.abs(w) < F.lit(float(pc.min_weight)), F.lit(0.0)).otherwise(w)
    gross = float(pc.gross_limit) * (1.0 - float(pc.cash_buffer))
    df = df.withColumn("__w", w if gross > 0 else F.lit(0.0))
    up, down = F.greatest(F.col("__w"), F.lit(0.0)), F.greatest(-F.col("__w"), F.lit(0.0))
    df = with_group_stats(df, DATE, {"__pos": F.sum(up), "__neg": F.sum(down)}, max_group=max_group)
    pos, neg = F.col("__pos"), F.col("__neg")
    if gross <= 0:
        scaled = F.col("__w")
    elif pc.long_short:
        limit = float(pc.net_limit)
        net = F.greatest(F.least(pos - neg, F.lit(limit)), F.lit(-limit))
        long_budget, short_budget = (F.lit(gross) + net) / 2, (F.lit(gross) - net) / 2
        invalid = (long_budget < 0) | (short_budget < 0)
        two_sided = F.when(invalid, F.raise_error(F.lit("invalid gross/net constraints: a side budget is negative")).cast("double")).otherwise(
            F.coalesce(F.try_divide(up * long_budget, pos), F.lit(0.0)) - F.coalesce(F.try_divide(down * short_budget, neg), F.lit(0.0))
        )
        one_sided = F.coalesce(F.try_divide(F.col("__w") * F.lit(gross), pos + neg), F.lit(0.0))
        scaled = F.when((pos > 0) & (neg > 0), two_sided).otherwise(one_sided)
    else:
        budget = min(gross, float(pc.net_limit)) if pc.net_limit > 0 else gross
        scaled = F.coalesce(F.try_divide(up * F.lit(budget), pos), F.lit(0.0))
    df = df.withColumn("__scaled", scaled)
    cap = F.lit(float(pc.max_weight))
    clipped = F.greatest(F.least(F.col("__scaled"), cap), -cap if pc.long_short else F.lit(0.0))
    return df.withColumns({"__over": F.abs("__scaled") > cap, "target_weight": F.when(F.col("is_executable"), clipped).otherwise(F.lit(0.0))})


def _warnings(df: DataFrame, pc: Construction) -> DataFrame:
    """(date, code) rows; one partial aggregate per date finds all of them."""
    gross = float(pc.gross_limit) * (1.0 - float(pc.cash_buffer))
    per_date = df.groupBy("date").agg(
        F.count_if("is_executable").alias("run"), F.bool_or(~F.col("is_tradable")).alias("blocked"), F.max("__left").alias("left"),
        F.bool_or("__flat").alias("flat"), F.max("__pos").alias("pos"), F.max("__neg").alias("neg"), F.bool_or("__over").alias("over"),
    )
    some, invest, held = F.col("run") > 0, F.lit(gross > 0), (F.col("pos") + F.col("neg")) > 0
    zscore = pc.intent_method == "zscore_proportional"
    short_of = pc.intent_method == "rank_topbottom_equal"
    found = {
        "trade_when_not_tradable_enabled": F.lit(pc.trade_when_not_tradable) & F.col("blocked"),
        "no_executable_assets": ~some,
        "insufficient_short_candidates": F.lit(short_of) & some & (F.col("left") < F.lit(pc.bottom_k or 0)),
        "zero_signal_variance": F.lit(zscore) & some & F.col("flat"),
        "non_positive_investable_gross": some & ~invest,
        "long_short_side_missing": F.lit(pc.long_short) & some & invest & held & ((F.col("pos") == 0) | (F.col("neg") == 0)),
        "max_weight_clipped": some & invest & F.col("over"),
        "long_only_net_limit_zero_ignored": F.lit(not pc.long_short and pc.net_limit == 0) & some & invest & held,
    }
    codes = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in found.items()]))
    return per_date.select("date", F.explode(codes).alias("code"))


def build_target_weights(
    signal: DataFrame, universe: DataFrame, tradability: DataFrame, construction: Construction, *, max_group: int | None = None
) -> dict[str, DataFrame]:
    """Target weights of every key, per-date exposure diagnostics and warning rows."""
    pc = construction
    rows = executable_mask(signal, universe, tradability, trade_when_not_tradable=pc.trade_when_not_tradable)
    rows = _constrained(_raw(rows, pc, max_group), pc, max_group)
    diagnostics = rows.groupBy("date").agg(
        F.sum(F.abs("target_weight")).alias("gross_exposure"),
        F.sum("target_weight").alias("net_exposure"),
        F.count_if(F.col("target_weight") != 0).alias("n_positions"),
        F.count_if("is_executable").alias("n_executable_assets"),
        F.count_if("in_universe").alias("n_universe_assets"),
    )
    return {
        "target_weights": rows.select("date", "asset", "signal_value", "in_universe", "is_tradable", "is_executable", "target_weight"),
        "diagnostics": diagnostics,
        "warnings": _warnings(rows, pc),
    }
