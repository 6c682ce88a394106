"""Table contracts: every rule of a table is counted in one aggregate pass.

``*_violations`` return a (rule, n) table; ``validate_*`` raise ``ValueError`` when a count
is positive. Row order is not a property of a distributed table, so order rules of in-memory
panels reduce to key uniqueness here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.columns import as_col
from panelyard.functions.groups import dealt
from panelyard.functions.storage import written_rows

SIGNAL_COLUMNS = ("date", "asset", "factor", "value")


def require_columns(df: DataFrame, columns: Sequence[str], table: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{table} is missing required columns: {missing}")


def _blank(name: str) -> Column:
    return F.trim(F.col(name).cast("string")) == ""


def _missing_number(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(F.col(name).cast("double"))


def rule_counts(df: DataFrame, rules: Mapping[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """One row per rule with the number of offending rows.

    ``key`` adds ``duplicate_key``: rows beyond the first of each key. Keys are pre-grouped,
    so the counts of the rules and of the keys come from the same shuffle.
    """
    counts = {name: F.count_if(F.coalesce(cond, F.lit(False))) for name, cond in rules.items()}
    if key:
        parts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *[c.alias(n) for n, c in counts.items()])
        one = parts.agg(
            F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
            *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
            F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_key"),
        )
    else:
        one = df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])
    names = [*counts, *(["duplicate_key"] if key else [])]
    empty = (F.col("rows") == 0).cast("long")
    pairs = [F.struct(F.lit("empty_table").alias("rule"), empty.alias("n"))]
    pairs += [F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in names]
    return one.select(F.inline(F.array(*pairs)))


def raise_on(violations: DataFrame, table: str) -> None:
    """Raise when any rule of a (rule, n) table is broken; the table has one row per rule."""
    broken = violations.where("n > 0").collect()
    if broken:
        listed = ", ".join(f"{r['rule']}={r['n']}" for r in sorted(broken, key=lambda r: r["rule"]))
        raise ValueError(f"{table} breaks its contract: {listed}")


def require_rules(df: DataFrame, rules: Mapping[str, Column], table: str, key: Sequence[str] = ()) -> None:
    """Raise when a row breaks a rule or repeats a key: one aggregate pass. An empty table breaks none."""
    raise_on(rule_counts(df, rules, key).where("rule <> 'empty_table'"), table)


def require_unique(df: DataFrame, key: Sequence[str], table: str) -> None:
    """Raise when two rows share a key."""
    require_rules(df, {}, table, key)


def require_unique_tables(tables: Mapping[str, DataFrame], key: Sequence[str]) -> None:
    """``require_unique`` of several tables with the same key, in one pass over all.

    Keys hardly repeat, so adding them up before the exchange only fills memory: written tables are dealt by key first.
    """
    parts = [df.select(F.lit(i).alias("__table"), *key) for i, df in enumerate(tables.values())]
    rows = [written_rows(df) for df in tables.values()]
    every = dealt(reduce(DataFrame.unionByName, parts), ["__table", *key], None if None in rows else sum(rows))
    counted = every.groupBy("__table", *key).agg((F.count(F.lit(1)) - 1).alias("n"))
    broken = counted.groupBy("__table").agg(F.sum("n").alias("n")).where("n > 0").collect()  # a row a table
    if broken:
        first = min(broken, key=lambda r: r["__table"])
        raise ValueError(f"{list(tables)[first['__table']]} breaks its contract: duplicate_key={first['n']}")


def price_violations(df: DataFrame) -> DataFrame:
    require_columns(df, ("date", "asset", "close"), "prices")
    rules = {
        "invalid_date": F.col("date").isNull(),
        "null_asset": F.col("asset").isNull(),
        "blank_asset": _blank("asset"),
        "null_close": _missing_number("close"),
        "non_positive_close": F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double")) <= 0,
    }
    return rule_counts(df, rules, ("date", "asset"))


def validate_price_panel(df: DataFrame) -> None:
    raise_on(price_violations(df), "price panel")


validate_prices_table = validate_price_panel


def signal_violations(df: DataFrame) -> DataFrame:
    require_columns(df, SIGNAL_COLUMNS, "signals")
    rules = {
        "invalid_date": F.col("date").isNull(),
        "null_asset": F.col("asset").isNull(),
        "blank_asset": _blank("asset"),
        "null_factor": F.col("factor").isNull(),
        "blank_factor": _blank("factor"),
    }
    present = F.count_if(~_missing_number("value"))
    all_null = df.agg(
        F.lit("all_values_null").alias("rule"), ((F.count(F.lit(1)) > 0) & (present == 0)).cast("long").alias("n")
    )
    return rule_counts(df, rules, SIGNAL_COLUMNS[:3]).unionByName(all_null)


def validate_factor_output(df: DataFrame, table_name: str = "factor output") -> None:
    require_columns(df, SIGNAL_COLUMNS, table_name)
    if not isinstance(df.schema["value"].dataType, T.NumericType):
        raise ValueError(f"{table_name}.value must be numeric")
    raise_on(signal_violations(df), table_name)


def validate_canonical_signal_table(df: DataFrame, *, table_name: str) -> None:
    """As ``validate_factor_output``, but a table whose values are all null is accepted."""
    require_columns(df, SIGNAL_COLUMNS, table_name)
    if not isinstance(df.schema["value"].dataType, T.NumericType):
        raise ValueError(f"{table_name}.value must be numeric")
    raise_on(signal_violations(df).where("rule <> 'all_values_null'"), table_name)


def mask_violations(df: DataFrame, flag_col: str) -> DataFrame:
    require_columns(df, ("date", "asset", flag_col), flag_col)
    rules = {
        "invalid_date": F.col("date").isNull(),
        "null_asset": F.col("asset").isNull(),
        "blank_asset": _blank("asset"),
    }
    return rule_counts(df, rules, ("date", "asset"))


def _validate_mask(df: DataFrame, flag_col: str, table: str) -> None:
    require_columns(df, ("date", "asset", flag_col), table)
    if not isinstance(df.schema[flag_col].dataType, T.BooleanType):
        raise ValueError(f"{table}.{flag_col} must be boolean")
    raise_on(mask_violations(df, flag_col), table)


def validate_universe_table(df: DataFrame) -> None:
    _validate_mask(df, "in_universe", "universe")


def validate_tradability_table(df: DataFrame) -> None:
    _validate_mask(df, "is_tradable", "tradability")


def support_mismatch(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("date", "asset")) -> DataFrame:
    """One row: keys present on one side only."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    return a.join(b, list(keys), "full_outer").agg(
        F.count_if(F.col("__r").isNull()).alias("only_left"), F.count_if(F.col("__l").isNull()).alias("only_right")
    )


def validate_same_support(universe: DataFrame, tradability: DataFrame) -> None:
    row = support_mismatch(universe, tradability).first()
    if row["only_left"] or row["only_right"]:
        raise ValueError("universe and tradability must share the same (date, asset) support")


def label_violations(df: DataFrame) -> DataFrame:
    require_columns(df, ("date", "asset", "label_name"), "labels")
    rules = {
        "invalid_date": F.col("date").isNull(),
        "null_asset": F.col("asset").isNull(),
        "invalid_label_name": F.col("label_name").isNull() | _blank("label_name"),
    }
    return rule_counts(df, rules, ("date", "asset", "label_name"))


def validate_unified_label_table(df: DataFrame) -> None:
    from panelyard.operators.labels import UNIFIED_LABEL_COLUMNS

    require_columns(df, UNIFIED_LABEL_COLUMNS, "labels")
    raise_on(label_violations(df), "unified label table")


def coerce_bool(c: Column | str) -> Column:
    """Strict boolean: 1/0/true/false in any case and padding; NULL for anything else."""
    text = F.lower(F.trim(as_col(c).cast("string")))
    return F.when(text.isin("1", "true"), F.lit(True)).when(text.isin("0", "false"), F.lit(False))


def bool_violations(df: DataFrame, column: str) -> DataFrame:
    return rule_counts(df, {f"non_boolean_{column}": coerce_bool(column).isNull()})


def signal_snapshot(factors: DataFrame, assignments: DataFrame) -> DataFrame:
    """Signal rows on evaluation dates that carry a value."""
    dates = assignments.select("date").distinct()
    return factors.where(~_missing_number("value")).join(dates, "date", "left_semi").select(
        "date", "asset", F.col("factor").alias("signal_name"), F.col("value").alias("signal_value")
    )


def slice_to_signal_dates(table: DataFrame, signal: DataFrame) -> DataFrame:
    """Rows of a mask or label table on the dates of the signal snapshot."""
    return table.join(signal.select("date").distinct(), "date", "left_semi")


def missing_keys(signal: DataFrame, table: DataFrame) -> DataFrame:
    """Keys of ``signal`` that ``table`` does not cover."""
    return signal.select("date", "asset").distinct().join(table.select("date", "asset"), ["date", "asset"], "left_anti")


def uncovered_exclusions(tradability: DataFrame, exclusion_reasons: DataFrame) -> DataFrame:
    """Non-tradable keys without an exclusion reason."""
    return missing_keys(tradability.where(~F.col("is_tradable")), exclusion_reasons)


def assert_exclusion_reason_coverage(tradability: DataFrame, exclusion_reasons: DataFrame) -> None:
    n = uncovered_exclusions(tradability, exclusion_reasons).count()
    if n:
        raise ValueError(f"exclusion reasons are missing for non-tradable keys; missing_count={n}")


def bundle_violations(signal: DataFrame, universe: DataFrame, tradability: DataFrame) -> DataFrame:
    """Coverage and key uniqueness of a signal with its two masks, as a (rule, n) table."""

    def count(df: DataFrame, rule: str) -> DataFrame:
        return df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))

    out = count(missing_keys(signal, universe), "missing_in_universe").unionByName(
        count(missing_keys(signal, tradability), "missing_in_tradability")
    )
    for name, df in (("signal", signal), ("universe", universe), ("tradability", tradability)):
        per_key = df.groupBy("date", "asset").count()
        out = out.unionByName(
            per_key.agg(
                F.lit(f"duplicate_{name}").alias("rule"), F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")
            )
        )
    return out


def validate_input_bundle(signal: DataFrame, universe: DataFrame, tradability: DataFrame) -> None:
    raise_on(bundle_violations(signal, universe, tradability), "bundle")


def _canonical_text(field: T.StructField) -> Column:
    c = F.col(field.name)
    if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif isinstance(field.dataType, T.NumericType):
        text = F.nanvl(c.cast("double"), F.lit(None).cast("double")).cast("string")
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("<NA>"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and content fingerprint, blind to row and column order.

    Each row is hashed over its columns in name order; row hashes are added up, which is
    commutative, so no global sort is needed and duplicates count.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    digest = F.sha2(F.concat_ws("\u0001", *[_canonical_text(f) for f in fields]), 256)
    parts = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)
    ]
    summed = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    names = ",".join(f.name for f in fields)
    text = F.concat_ws(
        "|", F.lit(names), F.col("rows").cast("string"), *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4)]
    )
    return summed.select("rows", F.sha2(text, 256).alias("fingerprint"))


def dataset_fingerprint(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named table: table, rows, fingerprint."""
    if not tables:
        raise ValueError("tables must contain at least one DataFrame")
    out = None
    for name in sorted(tables):
        row = table_fingerprint(tables[name]).select(F.lit(name).alias("table"), "rows", "fingerprint")
        out = row if out is None else out.unionByName(row)
    return out
