"""Both physical strategies of the group primitives against pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyard.functions import groups
from panelyard.functions.columns import pair_corr, rounded


@pytest.fixture(scope="module")
def table(spark):
    """Group 'hot' holds most rows, a third of them at one value; nulls everywhere."""
    rng = np.random.default_rng(3)
    rows = []
    for g, n in (("hot", 3000), ("small", 40), ("flat", 25)):
        for i in range(n):
            v = 1.5 if (g == "flat" or i % 3 == 0) else float(np.round(rng.normal(), 2))
            rows.append((g, f"x{i:05d}", None if i % 17 == 5 else v))
    pdf = pd.DataFrame(rows, columns=["g", "asset", "v"])
    return spark.createDataFrame(rows, "g string, asset string, v double"), pdf


@pytest.mark.parametrize("options", [dict(max_group=3000), dict(split_rows=100), dict(split_rows=7), dict(split_rows=10_000)])
def test_ranks(table, options):
    df, pdf = table
    out = groups.with_ranks(
        df, ["g"], F.col("v"), minimum="lo", average="avg", dense="dense", size="n", distinct="u", **options
    ).toPandas().sort_values(["g", "asset"]).reset_index(drop=True)
    pdf = pdf.sort_values(["g", "asset"]).reset_index(drop=True)
    by = pdf.groupby("g")["v"]
    assert len(out) == len(pdf)
    for name, method in (("lo", "min"), ("avg", "average"), ("dense", "dense")):
        np.testing.assert_allclose(out[name].astype(float), by.rank(method=method), err_msg=name)
    assert (out["n"] == by.transform("count")).all()
    assert (out["u"] == by.transform("nunique")).all()


@pytest.mark.parametrize("options", [dict(max_group=3000), dict(split_rows=64)])
def test_row_number_is_rank_of_a_total_order(table, options):
    df, pdf = table
    order = F.when(F.col("v").isNotNull(), F.struct((-F.col("v")).alias("v"), F.col("asset")))
    out = groups.with_ranks(df, ["g"], order, minimum="k", **options).where("k is not null").toPandas()
    want = pdf.dropna().sort_values(["g", "v", "asset"], ascending=[True, False, True])
    want["k"] = want.groupby("g").cumcount() + 1
    both = out.merge(want, on=["g", "asset"])
    assert len(both) == len(want) and (both["k_x"] == both["k_y"]).all()


def test_range_split_spreads_the_hot_group(table):
    """No task of the split strategy holds more than a small share of the hot group."""
    df, _ = table
    base = df.withColumn("__rk_o", F.col("v"))
    hot = base.where("v is not null").groupBy("g").agg(F.count("*").alias("__n")).where("__n > 100")
    names = dict(minimum="lo", average=None, dense=None, size=None, distinct=None)
    plan = groups._rank_by_ranges(base, ["g"], names, hot, ["asset"], 100)
    assert plan.count() == 3065
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "__rk_code" in text and "__rk_salt" in text


@pytest.mark.parametrize("options", [dict(max_group=3000), dict(split_rows=50)])
def test_quantiles(table, options):
    df, pdf = table
    out = groups.group_quantiles(df, ["g"], F.col("v"), (0.05, 0.5, 0.99), ("a", "b", "c"), **options).toPandas().set_index("g")
    want = pdf.groupby("g")["v"].quantile([0.05, 0.5, 0.99]).unstack()
    np.testing.assert_allclose(out.loc[want.index, ["a", "b", "c"]], want)


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_rows_are_searched_in_short_arrays(spark, table, monkeypatch, broadcast):
    """No array that a row is searched in grows with its group: a group of 600 cuts had one of 600 beside each row."""
    monkeypatch.setattr(groups, "CUTS", 8)
    monkeypatch.setattr(groups, "BROADCAST_ROWS", broadcast)
    lengths = []
    beside = groups._beside

    def seen(rows, side, keys, held):
        lengths.append(side.agg(F.max(F.size(side.columns[-1]))).first()[0])
        return beside(rows, side, keys, held)

    monkeypatch.setattr(groups, "_beside", seen)
    df, pdf = table
    out = groups.with_ranks(df, ["g"], F.col("v"), minimum="lo", average="avg", dense="dense", split_rows=7).toPandas()
    want = pdf.assign(**{n: pdf.groupby("g")["v"].rank(method=m) for n, m in (("lo", "min"), ("avg", "average"), ("dense", "dense"))})
    got, want = (t.sort_values(["g", "asset"])[["lo", "avg", "dense"]].astype(float) for t in (out, want))
    np.testing.assert_allclose(got, want)
    assert len(lengths) == 2 and max(lengths) < 40


@pytest.mark.parametrize("max_group", [None, 5000])
def test_group_stats(table, max_group):
    df, pdf = table
    out = groups.with_group_stats(df, ["g"], {"m": F.avg("v"), "n": F.count("v")}, max_group=max_group).toPandas()
    want = pdf.groupby("g")["v"].agg(["mean", "count"])
    np.testing.assert_allclose(out["m"], out["g"].map(want["mean"]))
    assert (out["n"] == out["g"].map(want["count"])).all()


def test_max_group_rows(table):
    assert groups.max_group_rows(table[0], ["g"]) == 3000


def test_pair_corr_guards_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, None)], "g string, x double, y double")
    got = {r["g"]: r["c"] for r in df.groupBy("g").agg(pair_corr(F.col("x"), F.col("y")).alias("c")).collect()}
    assert got["a"] is None and got["c"] is None and got["b"] == pytest.approx(1.0)


def test_rounded_keeps_other_columns(spark):
    row = rounded(spark.createDataFrame([(1, 0.123456)], "a int, b double"), 3).first()
    assert row["a"] == 1 and row["b"] == 0.123


INF = float("inf")
ODD = [
    ("up", v) for v in (1.0, 2.0, 2.0, 3.0, INF, INF, INF)] + [("down", v) for v in (-INF, -INF, 0.5, None)] + [("both", v) for v in (-INF, INF)] + [
    ("nan", v) for v in (float("nan"), 4.0, 5.0, None)] + [("void", None)] + [("ties", float(i % 3)) for i in range(50)] + [("third", 0.1 + 0.2 * i) for i in range(10)]
PATHS = [dict(max_group=50), dict(), dict(split_rows=3), dict(split_rows=10)]


def test_quantiles_are_the_same_on_every_path(spark):
    """Infinite values, ties, NULLs, NaN and no id columns: identical to the last bit."""
    df = spark.createDataFrame(ODD, "g string, v double")
    got = [
        sorted(map(tuple, groups.group_quantiles(df, ["g"], F.col("v"), (0.0, 0.05, 0.5, 0.95, 1.0), list("abcde"), **o).collect())) for o in PATHS
    ]
    assert all(g == got[0] for g in got)
    by = {r[0]: r[1:] for r in got[0]}
    assert by["up"] == (1.0, pytest.approx(1.3), 3.0, INF, INF) and by["void"] == (None,) * 5
    assert by["both"] == (-INF, None, None, None, INF) and by["nan"][2] == 4.5


@pytest.mark.parametrize("options", PATHS)
def test_ranks_without_id_columns(spark, options):
    df = spark.createDataFrame(ODD, "k string, w double")
    out = groups.with_ranks(df, ["k"], F.when(~F.isnan("w"), F.col("w")), minimum="lo", average="avg", dense="dense", size="n", **options).toPandas()
    want = pd.DataFrame(ODD, columns=["k", "w"])
    for name, method in (("lo", "min"), ("avg", "average"), ("dense", "dense")):
        want[name] = want.groupby("k")["w"].rank(method=method)
    key = ["k", "w", "lo"]
    np.testing.assert_allclose(out.sort_values(key)[["lo", "avg", "dense"]].astype(float), want.sort_values(key)[["lo", "avg", "dense"]])


def test_lower_bound_of_large_and_missing_arrays(spark):
    row = spark.range(1).select(
        groups.lower_bound(F.sequence(F.lit(0), F.lit(200_000)), F.lit(123_456)).alias("a"), groups.lower_bound(F.array().cast("array<int>"), F.lit(1)).alias("b"),
        groups.lower_bound(F.lit(None).cast("array<int>"), F.lit(1)).alias("c"), groups.lower_bound(F.array(F.lit(1)), F.lit(5)).alias("d"),
    ).first()
    assert tuple(row) == (123_456, 0, 0, 1)
