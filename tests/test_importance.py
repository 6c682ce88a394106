"""Permutations, and importances of models whose right answer is known."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from panelyard.operators import importance as imp


@pytest.mark.parametrize("n", [1, 2, 3, 7, 50, 64, 65, 1000, 4097])
def test_keyed_permutation_is_one_to_one(spark, n):
    rows = spark.range(n).select(imp.keyed_permutation(F.col("id"), n, 3).alias("p"), imp.keyed_permutation(F.col("id"), n, 4).alias("q")).collect()
    assert sorted(r["p"] for r in rows) == sorted(r["q"] for r in rows) == list(range(n))
    if n >= 50:
        p, q = np.array(rows).T
        assert (p == np.arange(n)).mean() < 0.1 and (p == q).mean() < 0.1 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.3


@pytest.fixture(scope="module")
def table(spark):
    """y = 2 a - b + noise; c has no part in it."""
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (900, 3))
    y = 2 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 900)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    return imp.contiguous_folds(df, order=["id"]), x, y


def test_permuted_column_is_a_permutation(spark, table):
    numbered, sizes = imp._numbered_folds(table[0], ["id"])
    assert sizes == {0: 300, 1: 300, 2: 300}
    fold = numbered.where("fold = 1")
    before, after = (sorted(map(tuple, d.select("id", "a", "b").collect())) for d in (fold, imp._permuted(fold, "a", 300, 5)))
    assert [r[0] for r in before] == [r[0] for r in after] and [r[2] for r in before] == [r[2] for r in after]
    assert sorted(r[1] for r in before) == sorted(r[1] for r in after) and before != after


def test_mda_of_a_linear_model(table):
    """R2 lost by permuting x_j is 2 w_j^2 var(x_j) / var(y) for independent features."""
    r2 = RegressionEvaluator(labelCol="label", metricName="r2")
    rows = {r["feature"]: r for r in imp.mda_importance(LinearRegression(labelCol="label"), table[0], ["a", "b", "c"], r2, row_id=["id"]).collect()}
    var = table[2].var()
    for f, w in (("a", 2), ("b", -1), ("c", 0)):
        assert rows[f]["mda_importance_mean"] == pytest.approx(2 * w * w / var, abs=0.12) and rows[f]["n_folds"] == 3
    assert abs(rows["c"]["mda_importance_mean"]) < 0.005


def test_sfi_of_a_linear_model(table):
    """The R2 of one feature alone is its squared correlation with the label."""
    r2 = RegressionEvaluator(labelCol="label", metricName="r2")
    rows = {r["feature"]: r["sfi_score_mean"] for r in imp.sfi_importance(lambda: LinearRegression(labelCol="label"), table[0], ["a", "b", "c"], r2).collect()}
    for j, f in enumerate("abc"):
        assert rows[f] == pytest.approx(np.corrcoef(table[1][:, j], table[2])[0, 1] ** 2, abs=0.05)


def test_mdi_of_a_forest(table):
    model = RandomForestRegressor(labelCol="label", numTrees=10, maxDepth=5, seed=3).fit(imp.assemble(table[0], ["a", "b", "c"]))
    rows = {r["feature"]: r["mdi_importance"] for r in imp.mdi_importance(model, ["a", "b", "c"], table[0]).collect()}
    assert sum(rows.values()) == pytest.approx(1.0) and rows["a"] > rows["b"] > 5 * rows["c"] and rows["a"] > 0.6
