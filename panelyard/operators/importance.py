"""Feature importance on Spark ML models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from math import isqrt

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize

FEATURES = "features"


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES).transform(df)


def contiguous_folds(df: DataFrame, *, order: Sequence[str], n_folds: int = 3) -> DataFrame:
    """Add ``fold``: contiguous blocks of the order, of (nearly) equal size.

    Block edges are exact quantile rows of the order, found without a global sort in one task.
    """
    from panelyard.functions.groups import with_ranks

    ranked = with_ranks(df.withColumn("__all", F.lit(1)), ["__all"], F.struct(*order), minimum="__k", size="__n", row_id=list(order))
    # The first n % folds blocks hold one row more.
    p, q, r = "(__k - 1)", f"(__n div {n_folds})", f"(__n % {n_folds})"
    fold = F.expr(f"if({p} < {r} * ({q} + 1), {p} div ({q} + 1), {r} + ({p} - {r} * ({q} + 1)) div greatest({q}, 1))")
    return ranked.withColumn("fold", fold.cast("int")).drop("__all", "__k", "__n")


def mdi_importance(model: Model, features: Sequence[str], like: DataFrame) -> DataFrame:
    """Impurity importances of a fitted tree model, one row per feature."""
    if not hasattr(model, "featureImportances"):
        raise ValueError("model does not expose featureImportances")
    values = model.featureImportances.toArray()
    if len(values) != len(features):
        raise ValueError("featureImportances length does not match features")
    rows = [(f, float(v)) for f, v in zip(features, values, strict=True)]
    return like.sparkSession.createDataFrame(rows, "feature string, mdi_importance double")


def keyed_permutation(k: Column, n: int, seed: int, rounds: int = 6) -> Column:
    """Place of number ``k`` of 0 .. n - 1 in a pseudo-random permutation of these numbers, by ``k`` alone.

    A Feistel network over pairs (k div b, k mod b) permutes a * b numbers, the least such rectangle around n; a number
    that leaves 0 .. n - 1 is sent on until it is back, which keeps the map one to one.
    """
    a = max(1, isqrt(max(1, n) - 1) + 1)
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        left, right = F.floor(x / b).cast("long"), F.pmod(x, F.lit(b)).cast("long")
        for r in range(rounds):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), left), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(r), right), F.lit(a)), F.lit(a))
        return (left * b + right).cast("long")

    steps = F.sequence(F.lit(1), F.lit(64))  # fewer than sqrt(n) + 1 numbers lie outside, so a walk among them is short
    return F.aggregate(steps, F.lit(-1).cast("long"), lambda at, i: F.when(i == 1, once(k.cast("long"))).when(at >= n, once(at)).otherwise(at))


def _permuted(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Rows numbered by ``__k`` with one column shuffled: each takes the value of the row at its permuted number, by one join."""
    values = df.select(F.col("__k").alias("__from"), F.col(column).alias("__v"))
    return df.withColumn("__from", keyed_permutation(F.col("__k"), n, seed)).join(values, "__from").withColumn(column, F.col("__v")).drop("__from", "__v")


def _numbered_folds(df: DataFrame, row_id: Sequence[str]) -> tuple[DataFrame, dict[int, int]]:
    """The table with rows numbered from 0 in each fold, ranked once and written; and the rows of each fold."""
    from panelyard.functions.groups import with_ranks

    ranked = with_ranks(df, ["fold"], F.struct(*[F.col(c) for c in row_id]), minimum="__k", row_id=list(row_id))
    table = materialize(ranked.withColumn("__k", F.col("__k") - 1))
    return table, {r["fold"]: r["n"] for r in table.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).orderBy("fold").collect()}


def _folds(df: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in df.select("fold").distinct().collect())


#: model fits and evaluations that run at a time
JOBS = 4


def _together(spark: SparkSession, tasks: Sequence[Callable[[], tuple]]) -> list[tuple]:
    """Results of independent fits, a bounded number of them at a time; the cluster shares its slots among their jobs."""
    with ThreadPoolExecutor(JOBS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(lambda task: task()), tasks))


def _summary(scores: DataFrame, prefix: str) -> DataFrame:
    return scores.groupBy("feature").agg(
        F.avg("score").alias(f"{prefix}_mean"), F.stddev_samp("score").alias(f"{prefix}_std"), F.count(F.lit(1)).alias("n_folds")
    )


def mda_importance(
    estimator: Estimator, df: DataFrame, features: Sequence[str], evaluator: Evaluator, *, row_id: Sequence[str], random_state: int = 0
) -> DataFrame:
    """Mean and deviation over folds of the score lost when a feature is permuted (``df`` has a ``fold`` column).

    Rows are numbered once; a permuted feature is a join on numbers. Folds are fitted together.
    """
    table, sizes = _numbered_folds(df, row_id)

    def of_fold(fold: int) -> Callable[[], list[tuple[str, int, float]]]:
        def run() -> list[tuple[str, int, float]]:
            train, test = table.where(F.col("fold") != fold), table.where(F.col("fold") == fold)
            model = estimator.fit(assemble(train, features))
            score = lambda rows: evaluator.evaluate(model.transform(assemble(rows, features)))
            base = score(test)
            return [(f, fold, float(base - score(_permuted(test, f, sizes[fold], random_state + i)))) for i, f in enumerate(features)]

        return run

    rows = [r for found in _together(df.sparkSession, [of_fold(f) for f in sizes]) for r in found]
    return _summary(df.sparkSession.createDataFrame(rows, "feature string, fold int, score double"), "mda_importance")


def sfi_importance(estimator_factory: Callable[[], Estimator], df: DataFrame, features: Sequence[str], evaluator: Evaluator) -> DataFrame:
    """Score of a model that sees one feature only, over folds; all fits are independent and run together."""
    table = materialize(df.select("fold", *dict.fromkeys([*features, *[c for c in (evaluator.getOrDefault("labelCol"),) if c in df.columns]])))

    def fit(feature: str, fold: int) -> Callable[[], tuple[str, int, float]]:
        def run() -> tuple[str, int, float]:
            model = estimator_factory().fit(assemble(table.where(F.col("fold") != fold), [feature]))
            return feature, fold, float(evaluator.evaluate(model.transform(assemble(table.where(F.col("fold") == fold), [feature]))))

        return run

    rows = _together(df.sparkSession, [fit(f, fold) for fold in _folds(table) for f in features])
    return _summary(df.sparkSession.createDataFrame(rows, "feature string, fold int, score double"), "sfi_score")


def cluster_importance(importance: DataFrame, clusters: DataFrame, *, importance_col: str) -> DataFrame:
    """Sum and mean importance of the features of each cluster; features without a value add 0 to the sum."""
    merged = clusters.join(importance.select("feature", importance_col), "feature", "left")
    return merged.groupBy("cluster_id").agg(
        F.count_distinct("feature").alias("n_features"), F.coalesce(F.sum(importance_col), F.lit(0.0)).alias("importance_sum"),
        F.avg(importance_col).alias("importance_mean"),
    )


def build_feature_importance_report(
    fitted: Model, estimator: Estimator, factory: Callable[[], Estimator], df: DataFrame, features: Sequence[str], evaluator: Evaluator, *,
    row_id: Sequence[str], cluster_threshold: float = 0.8, random_state: int = 0,
) -> dict[str, DataFrame]:
    from panelyard.operators.composite import correlation_clusters
    from panelyard.operators.screening import pairwise_correlation

    items = [F.struct(F.lit(f).alias("factor"), F.col(f).cast("double").alias("value")) for f in features]
    long = df.select(*row_id, F.inline(F.array(*items)))
    pairs = pairwise_correlation(long, keys=tuple(row_id)).select(F.col("a").alias("alpha_a"), F.col("b").alias("alpha_b"), "corr")
    clusters = correlation_clusters(pairs, threshold=cluster_threshold).withColumnRenamed("name", "feature")
    mda = mda_importance(estimator, df, features, evaluator, row_id=row_id, random_state=random_state)
    return {
        "mdi": mdi_importance(fitted, features, df),
        "mda": mda,
        "sfi": sfi_importance(factory, df, features, evaluator),
        "clusters": clusters,
        "cluster_importance": cluster_importance(mda, clusters, importance_col="mda_importance_mean"),
    }
