"""Experiment registry, trial log and alpha registry as tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.groups import with_ranks
from panelyard.functions.storage import commit_version, stage_version, versions

# Column lists of the log tables.
SUMMARY_SCHEMA = (
    "factor_name STRING, label_name STRING, n_quantiles INT, split_description STRING, mean_ic DOUBLE, mean_rank_ic DOUBLE, ic_ir DOUBLE, "
    "mean_long_short_return DOUBLE, long_short_hit_rate DOUBLE, n_dates_used BIGINT, mean_long_short_turnover DOUBLE, cost_rate DOUBLE, "
    "mean_cost_adjusted_long_short_return DOUBLE"
)
TRIAL_LOG_SCHEMA = (
    "experiment_name STRING, trial_id STRING, trial_count INT, factor_name STRING, label_name STRING, dataset_id STRING, dataset_hash STRING, "
    "validation_scheme STRING, verdict STRING, mean_ic DOUBLE, mean_rank_ic DOUBLE, ic_ir DOUBLE, mean_long_short_return DOUBLE, "
    "mean_long_short_turnover DOUBLE, run_timestamp_utc STRING, git_commit STRING"
)
ALPHA_REGISTRY_SCHEMA = (
    "alpha_id STRING, taxonomy STRING, hypothesis STRING, economic_rationale STRING, neutralization_status STRING, validation_status STRING, "
    "ic_mean DOUBLE, ic_ir DOUBLE, decay_half_life DOUBLE, lifecycle_stage STRING, tags STRING, notes STRING, provenance STRING, updated_at_utc STRING"
)
EXPERIMENT_REGISTRY_SCHEMA = "experiment_name STRING, registered_at_utc STRING, " + SUMMARY_SCHEMA


def _typed(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def check_schema(df: DataFrame, schema: str, table: str) -> None:
    wanted = [(f.name, f.dataType.simpleString()) for f in _typed(schema).fields]
    found = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if wanted != found:
        raise ValueError(f"{table} schema mismatch: expected {wanted}, got {found}")


def _stored(spark: SparkSession, folders: Sequence[str], schema: str, path: str) -> DataFrame:
    """Rows of committed versions, or an empty table when nothing was committed yet."""
    if not folders:
        return spark.createDataFrame([], _typed(schema))
    stored = spark.read.parquet(*folders)
    check_schema(stored, schema, path)
    return stored


def load_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all commits to a log."""
    return _stored(spark, list(versions(spark, path).values()), schema, path)


def append_log(df: DataFrame, path: str, schema: str) -> None:
    """Commit new rows after an exact schema check of them and of the stored ones.

    Rows are written once, aside, and take the next free version: writers at the same time lose and double nothing.
    """
    check_schema(df, schema, "new rows")
    spark = df.sparkSession
    load_log(spark, path, schema)
    staged = stage_version(df, path)
    while not commit_version(spark, staged, path, max(versions(spark, path), default=0) + 1):
        pass  # another writer was first


def append_trial_log(df: DataFrame, path: str) -> None:
    append_log(df, path, TRIAL_LOG_SCHEMA)


def load_trial_log(spark: SparkSession, path: str) -> DataFrame:
    return load_log(spark, path, TRIAL_LOG_SCHEMA)


def register_experiment(summary: DataFrame, name: str, path: str, *, registered_at_utc: str) -> None:
    row = summary.select(F.lit(name).alias("experiment_name"), F.lit(registered_at_utc).alias("registered_at_utc"), *summary.columns)
    append_log(row, path, EXPERIMENT_REGISTRY_SCHEMA)


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    return load_log(spark, path, EXPERIMENT_REGISTRY_SCHEMA)


def trial_rows(summary: DataFrame, *, experiment_name: str, **facts: str | int | None) -> DataFrame:
    """Trial-log rows from an experiment summary; facts fill the provenance columns."""
    out = []
    for f in _typed(TRIAL_LOG_SCHEMA).fields:
        if f.name == "experiment_name":
            c = F.lit(experiment_name)
        elif f.name in facts:
            c = F.lit(facts[f.name])
        elif f.name in summary.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    return summary.select(*out)


def upsert(old: DataFrame, new: DataFrame, key: str = "alpha_id") -> DataFrame:
    """Old rows whose key is not in ``new``, plus the new rows."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def load_alpha_registry(spark: SparkSession, path: str) -> DataFrame:
    """Latest version of the registry; a version appears whole, by a rename."""
    return _stored(spark, list(versions(spark, path).values())[-1:], ALPHA_REGISTRY_SCHEMA, path)


def upsert_alpha_registry(entries: DataFrame, path: str, *, attempts: int = 50) -> DataFrame:
    """Commit the registry with ``entries`` replaced or added as its next version.

    If another writer has committed that version meanwhile, the entries are merged into it and tried as the one after, so
    no writer undoes another.
    """
    check_schema(entries, ALPHA_REGISTRY_SCHEMA, "entries")
    spark = entries.sparkSession
    for _ in range(attempts):
        known = versions(spark, path)
        latest = max(known, default=0)
        merged = upsert(_stored(spark, list(known.values())[-1:], ALPHA_REGISTRY_SCHEMA, path), entries)
        if commit_version(spark, stage_version(merged, path), path, latest + 1):
            return load_alpha_registry(spark, path)
    raise RuntimeError(f"{path} was changed by other writers {attempts} times")


def alpha_entries(summary: DataFrame, half_life: DataFrame, *, stage: str = "candidate", updated_at_utc: str | None = None) -> DataFrame:
    """One alpha-registry row per factor of an experiment summary."""
    joined = summary.join(half_life, "factor", "left")
    given = {
        "alpha_id": F.col("factor"), "ic_mean": F.col("mean_rank_ic"), "ic_ir": F.col("ic_ir"), "decay_half_life": F.col("half_life_periods"),
        "lifecycle_stage": F.lit(stage), "neutralization_status": F.lit("unknown"), "validation_status": F.lit("unspecified"),
        "updated_at_utc": F.lit(updated_at_utc),
    }
    return joined.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _typed(ALPHA_REGISTRY_SCHEMA).fields])


def alpha_registry_stage_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy("lifecycle_stage").agg(
        F.count_distinct("alpha_id").alias("n_alphas"), F.avg("ic_mean").alias("mean_ic_mean"), F.avg("ic_ir").alias("mean_ic_ir")
    )


def compare_experiments(summaries: Sequence[DataFrame]) -> DataFrame:
    if not summaries:
        raise ValueError("summaries must be a non-empty list")
    stacked = reduce(lambda a, b: a.unionByName(b), summaries)
    return stacked.withColumnsRenamed({"label_name": "label_factor", "n_quantiles": "quantiles"})


def rank_experiments(comparison: DataFrame, metric: str, *, ascending: bool = False) -> DataFrame:
    """Add ``rank``: by the metric, missing values last, ties by the other columns."""
    if metric not in comparison.columns:
        raise ValueError(f"metric {metric!r} is not a column of the comparison")
    value = F.col(metric) if ascending else -F.col(metric)
    others = [c for c in comparison.columns if c != metric]
    parts = [F.col(metric).isNull().alias("n"), value.alias("v")]
    for i, c in enumerate(others):
        parts += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"c{i}")]
    ranked = with_ranks(comparison.withColumn("__all", F.lit(1)), ["__all"], F.struct(*parts), minimum="rank", row_id=comparison.columns)
    return ranked.select("rank", *comparison.columns)
