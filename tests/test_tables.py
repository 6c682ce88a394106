from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from helpers import day, factor_table, panel, random_prices
from panelyard.functions.storage import commit_version, materialize, scratch_dir, stage_version, versions
from panelyard.operators import registry as reg
from panelyard.plans.ingest import build_research_inputs, standardize_raw_tables, write_standard_tables
from panelyard.sources import contracts as ct
from panelyard.sources import vendor
from panelyard.sources.tables import read_prices, read_raw_table, write_sorted


def counts(df):
    return {r["rule"]: r["n"] for r in df.collect()}


def test_price_contract(spark):
    good = random_prices(spark, 2, 3)
    ct.validate_price_panel(good)
    bad = spark.createDataFrame(
        [(day(0), "A", 1.0), (day(0), "A", 2.0), (None, "B", 0.0), (day(1), " ", None), (day(1), None, float("nan"))], "date date, asset string, close double"
    )
    got = counts(ct.price_violations(bad))
    assert got == {"empty_table": 0, "invalid_date": 1, "null_asset": 1, "blank_asset": 1, "null_close": 2, "non_positive_close": 1, "duplicate_key": 1}
    with pytest.raises(ValueError, match="duplicate_key=1"):
        ct.validate_price_panel(bad)
    with pytest.raises(ValueError, match="empty_table"):
        ct.validate_price_panel(good.limit(0))
    with pytest.raises(ValueError, match="missing required"):
        ct.validate_price_panel(good.drop("close"))


def test_signal_contract(spark):
    nothing = factor_table(spark, [(day(0), "A", "f", None)])
    with pytest.raises(ValueError, match="all_values_null"):
        ct.validate_factor_output(nothing)
    ct.validate_canonical_signal_table(nothing, table_name="signals")
    with pytest.raises(ValueError, match="numeric"):
        ct.validate_factor_output(nothing.withColumn("value", F.lit("x")))


def test_fingerprint(spark):
    df = random_prices(spark, 3, 4)

    def print_of(x):
        return ct.table_fingerprint(x).first()["fingerprint"]

    base = print_of(df)
    assert print_of(df.select("close", "asset", "date").orderBy(F.col("close").desc())) == base
    assert print_of(df.withColumn("close", F.when(F.col("asset") == "a00", F.col("close") + 1e-9).otherwise(F.col("close")))) != base
    assert print_of(df.unionByName(df.limit(1))) != base
    assert print_of(df.limit(0)) != base


def test_dates_and_booleans(spark):
    df = spark.createDataFrame([("20240131", "1"), ("2024-01-31", " True"), ("2024/01/31", "no"), ("2024-02-30", "0"), ("", "")], "d string, b string")
    got = df.select(vendor.normalize_date("d").alias("d"), ct.coerce_bool("b").alias("b")).collect()
    assert [str(r["d"]) for r in got] == ["2024-01-31"] * 3 + ["None"] * 2
    assert [r["b"] for r in got] == [True, True, None, False, None]
    bounds = spark.createDataFrame([("2023-11-15", "2024-02-01")], "s string, e string").select(F.col("s").cast("date").alias("start"), F.col("e").cast("date").alias("end"))
    assert sorted(str(r["period"]) for r in vendor.quarter_ends(bounds).collect()) == ["2023-12-31", "2024-03-31"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_price_round_trip(spark, fmt):
    path = f"{scratch_dir(spark)}/t_{fmt}_{tempfile.gettempprefix()}_{id(fmt)}"
    df = random_prices(spark, 3, 5)
    write_sorted(df, path, ["date", "asset"], fmt=fmt)
    back = read_prices(spark, path, fmt)
    assert back.exceptAll(df).count() == 0 and back.count() == 15


def test_missing_raw_table(spark):
    schema = "ts_code STRING, trade_date STRING"
    assert read_raw_table(spark, "/tmp/absent-raw", "suspend_d", schema, required=False).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_raw_table(spark, "/tmp/absent-raw", "daily", schema)


def test_ingestion_with_missing_endpoints(spark):
    raw = {
        "daily": spark.createDataFrame([(" a.x", "20240102", "10", "1", "2"), ("a.x", "20240103", "11", "0", "2")], "ts_code string, trade_date string, close string, vol string, amount string")
        .withColumns({"high": F.col("close"), "low": F.col("close")}),
        "daily_basic": spark.createDataFrame([("A.X", "20240102", 2.0, 5.0)], "ts_code string, trade_date string, pb double, total_mv double"),
        "stock_basic": spark.createDataFrame([("a.x", "20200101", "*ST foo", "L"), ("a.x", "20190101", "bar", "D")], "ts_code string, list_date string, name string, list_status string"),
        "trade_cal": spark.createDataFrame([("SSE", "20240102", 1)], "exchange string, cal_date string, is_open int"),
        "fina_indicator": spark.createDataFrame([("A.X", "20240103", "20231231", 0.1)], "ts_code string, ann_date string, end_date string, roe double"),
    }
    tables = standardize_raw_tables(raw)
    price = {str(r["date"]): r for r in tables["prices"].collect()}
    assert price["2024-01-02"]["volume"] == 100.0 and price["2024-01-02"]["dollar_volume"] == 2000.0 and price["2024-01-02"]["total_mv_yuan"] == 50000.0
    assert price["2024-01-03"]["pb"] is None
    meta = tables["asset_metadata"].collect()
    assert len(meta) == 1 and meta[0]["is_st"] and str(meta[0]["listing_date"]) == "2020-01-01"
    state = {str(r["date"]): r["is_halted"] for r in tables["market_state"].collect()}
    assert state == {"2024-01-02": False, "2024-01-03": True}
    path = f"{scratch_dir(spark)}/ingest_{id(raw)}"
    filled = {**tables, "prices": tables["prices"].withColumns({c: F.lit(None).cast("double") for c in ("open", "pre_close", "pct_chg", "change")})}
    write_standard_tables(filled, path)
    inputs = build_research_inputs(spark, path, max_group=10)
    quality = {str(r["date"]): r["value"] for r in inputs["candidate_signals"].where("factor = 'quality_profitability_proxy'").collect()}
    assert quality == {"2024-01-02": None, "2024-01-03": 0.1}


def test_coverage_of_exclusions(spark):
    mask = spark.createDataFrame([(day(0), "A", False), (day(0), "B", True)], "date date, asset string, is_tradable boolean")
    none = mask.select("date", "asset").limit(0)
    with pytest.raises(ValueError, match="missing_count=1"):
        ct.assert_exclusion_reason_coverage(mask, none)
    ct.assert_exclusion_reason_coverage(mask, mask.select("date", "asset"))


def test_logs(spark):
    path = f"{scratch_dir(spark)}/log_{id(spark)}"
    assert reg.load_trial_log(spark, path).count() == 0
    summary = spark.createDataFrame([("f", 0.1)], "factor_name string, mean_ic double")
    row = reg.trial_rows(summary, experiment_name="e", trial_count=2)
    reg.append_trial_log(row, path)
    reg.append_trial_log(row, path)
    assert reg.load_trial_log(spark, path).count() == 2
    with pytest.raises(ValueError, match="schema mismatch"):
        reg.append_trial_log(row.drop("verdict"), path)


def test_registry_upsert(spark):
    path = f"{scratch_dir(spark)}/registry_{id(spark)}"
    half = spark.createDataFrame([("a", 3.0)], "factor string, half_life_periods double")
    entries = reg.alpha_entries(spark.createDataFrame([("a", 0.1, 0.5), ("b", 0.2, 0.4)], "factor string, mean_rank_ic double, ic_ir double"), half)
    reg.upsert_alpha_registry(entries, path)
    out = reg.upsert_alpha_registry(entries.where("alpha_id = 'b'").withColumn("lifecycle_stage", F.lit("x")), path)
    assert sorted((r["alpha_id"], r["lifecycle_stage"]) for r in out.collect()) == [("a", "candidate"), ("b", "x")]


def test_materialized_table_survives_its_source(spark):
    df = panel(spark, {"A": [1.0, 2.0]})
    stored = materialize(df)
    assert "parquet" in stored._jdf.queryExecution().executedPlan().toString().lower()
    assert stored.schema == df.schema and stored.count() == 2


def test_two_writers_at_once_lose_and_double_nothing(spark, monkeypatch):
    """Another job commits between the reading of the latest version and the commit of the next one."""
    path = f"{scratch_dir(spark)}/registry_race_{id(spark)}"
    entry = lambda name, stage: spark.createDataFrame([(name, stage)], "alpha_id string, lifecycle_stage string").select(
        *[(F.col(f.name) if f.name in ("alpha_id", "lifecycle_stage") else F.lit(None)).cast(f.dataType).alias(f.name) for f in reg._typed(reg.ALPHA_REGISTRY_SCHEMA).fields]
    )
    reg.upsert_alpha_registry(entry("a", "old"), path)
    stage, between = reg.stage_version, [entry("b", "other writer"), entry("a", "other writer")]

    def interrupted(df, where):
        staged = stage(df, where)
        if between:
            other = between.pop()
            reg.upsert_alpha_registry(other, path)
        return staged

    monkeypatch.setattr(reg, "stage_version", interrupted)
    out = reg.upsert_alpha_registry(entry("c", "mine"), path)
    assert sorted(map(tuple, out.select("alpha_id", "lifecycle_stage").collect())) == [("a", "other writer"), ("b", "other writer"), ("c", "mine")]
    assert list(versions(spark, path)) == [1, 2, 3, 4]


def test_appends_at_once(spark, monkeypatch):
    path = f"{scratch_dir(spark)}/trials_race_{id(spark)}"
    row = reg.trial_rows(spark.createDataFrame([("f", 0.5)], "factor_name string, mean_ic double"), experiment_name="e")
    stage, others = reg.stage_version, [2]

    def interrupted(df, where):
        staged = stage(df, where)
        if others.pop() if others else 0:
            reg.append_trial_log(row, path)
            reg.append_trial_log(row, path)
        return staged

    monkeypatch.setattr(reg, "stage_version", interrupted)
    reg.append_trial_log(row, path)
    assert reg.load_trial_log(spark, path).count() == 3 and list(versions(spark, path)) == [1, 2, 3]


def test_a_version_is_committed_once(spark):
    path = f"{scratch_dir(spark)}/commits_{id(spark)}"
    first, second = (stage_version(spark.range(n), path) for n in (1, 2))
    assert versions(spark, path) == {}
    assert commit_version(spark, first, path, 1) and not commit_version(spark, second, path, 1) and commit_version(spark, second, path, 2)
    assert [spark.read.parquet(f).count() for f in versions(spark, path).values()] == [1, 2]
