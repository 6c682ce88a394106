"""Moments of many series at once: masked products of blocks of dense rows.

A key's values (one per series) become an array, the only exchange of the panel. A task turns batches of arrays into a
dense block X with its mask M and adds up M'M, X'M, X2'M and X'X, so what leaves it is a row a pair of series, however
many keys it has read; no row is made per key and pair. More than ``COLUMNS`` series are cut into column blocks: a task
then goes through its rows once per pair of blocks and holds the products of one pair of blocks at a time.

Values are taken relative to each series' mean, so that the moments lose no digits to its level. Whether a series is
constant on the keys that a pair shares isn't left to rounding: pairs whose variance is tiny are checked by their minima
and maxima in a second pass over just these series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.columns import clean, pair_corr
from panelyard.functions.groups import dealt
from panelyard.functions.storage import materialize, written_rows

#: series whose products a task holds at a time
COLUMNS = 512
#: series whose names and means the driver may hold
MAX_NAMES = 50_000
_SUMS = ("n", "sa", "sb", "qa", "qb", "p")


def series_means(values: DataFrame, name: str) -> list[tuple[str, float]]:
    """Sorted names with the mean of each series, 0 for one without a value."""
    rows = values.groupBy(F.col(name).cast("string").alias("n")).agg(F.avg(clean("value")).alias("m")).where("n is not null").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} series")
    return sorted((r["n"], r["m"] if r["m"] is not None and np.isfinite(r["m"]) else 0.0) for r in rows)


def key_arrays(values: DataFrame, keys: Sequence[str], name: str, names: Sequence[str]) -> DataFrame:
    """Per key the array ``cells`` of (c: number of the series, v: value) of its values."""
    spark = values.sparkSession
    codes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "n string, c int")  # at most MAX_NAMES rows
    present = values.select(*keys, F.col(name).cast("string").alias("n"), clean("value").alias("v")).where("v is not null")
    coded = present.join(F.broadcast(codes), "n").select(*keys, "c", "v")
    return dealt(coded, keys, written_rows(values)).groupBy(*keys).agg(F.collect_list(F.struct("c", "v")).alias("cells"))


def _dense(cells: pa.ListArray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifted values (0 where there is none) and mask of a batch of arrays; columns are the series."""
    sizes = cells.value_lengths().to_numpy(zero_copy_only=False)
    flat = cells.flatten()
    code = flat.field("c").to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(cells)), sizes) * len(shift) + code
    if len(np.unique(place)) != len(place):
        raise ValueError("a key has more than one value of a series")
    x, m = np.zeros((len(cells), len(shift))), np.zeros((len(cells), len(shift)))
    x.ravel()[place] = flat.field("v").to_numpy(zero_copy_only=False) - shift[code]
    m.ravel()[place] = 1.0
    return x, m


def pair_sums(arrays: DataFrame, means: Sequence[float], columns: int = COLUMNS) -> DataFrame:
    """Sums over the keys that both series have: a < b (numbers), n, sa, sb (values), qa, qb (squares), p (products)."""
    k = len(means)
    blocks = -(-k // columns)
    shift = np.array(means)
    pairs = [(a, b) for a in range(blocks) for b in range(a, blocks)]

    def rows(pair: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = pairs[pair]
        first, second = np.arange(a * columns, min(k, (a + 1) * columns)), np.arange(b * columns, min(k, (b + 1) * columns))
        i, j = np.nonzero(first[:, None] < second[None])
        for at in range(0, len(i), 50_000):
            u, v = i[at:at + 50_000], j[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(first[u], pa.int32()), pa.array(second[v], pa.int32()), *(pa.array(s[u, v]) for s in sums)], ["a", "b", *_SUMS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums = None, None
        for whole in batches:
            numbers = whole.column("pair").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if int(numbers[low]) != current:
                    if current is not None:
                        yield from rows(current, sums)
                    current = int(numbers[low])
                    a, b = (slice(x * columns, min(k, (x + 1) * columns)) for x in pairs[current])
                    sums = np.zeros((6, a.stop - a.start, b.stop - b.start))
                for at in range(low, high, 2_000):
                    x, m = _dense(whole.column("cells").slice(at, min(2_000, high - at)), shift)
                    xa, ma, xb, mb = x[:, a], m[:, a], x[:, b], m[:, b]
                    for s, left, right in zip(sums, (ma, xa, ma, xa * xa, ma, xa), (mb, mb, xb, mb, xb * xb, xb), strict=True):
                        s += left.T @ right
        if current is not None:
            yield from rows(current, sums)

    if blocks == 1:
        dealt = arrays.select(F.lit(0).alias("pair"), "cells")
    else:
        dealt = arrays.select(F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("pair"), "cells").sortWithinPartitions("pair")
    partial = dealt.mapInArrow(run, "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS))
    return partial.groupBy("a", "b").agg(*(F.sum(s).alias(s) for s in _SUMS))


def correlations(values: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Pairwise-complete correlation of every two series that share a key: a, b (names in order), corr.

    NULL for fewer than two shared keys or where a series is constant on them.
    """
    named = series_means(values, name)
    names, means = [n for n, _ in named], [m for _, m in named]
    spark = values.sparkSession
    if len(names) < 2:
        return spark.createDataFrame([], "a string, b string, corr double")
    n = F.col("n")
    var_a, var_b = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    sums = pair_sums(key_arrays(values, keys, name, names), means).where("n > 0")
    cov = F.col("p") - F.col("sa") * F.col("sb") / n
    tiny = (var_a <= 1e-9 * F.col("qa")) | (var_b <= 1e-9 * F.col("qb"))
    corr = F.when((n >= 2) & ~tiny, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, F.sqrt(F.greatest(var_a, F.lit(0.0))) * F.sqrt(F.greatest(var_b, F.lit(0.0)))))))
    codes = spark.createDataFrame(list(enumerate(names)), "c int, n string")
    of = lambda c: F.broadcast(codes.select(F.col("c").alias(c), F.col("n").alias(f"name_{c}")))  # noqa: E731  at most MAX_NAMES rows
    found = sums.select("a", "b", corr.alias("corr"), ((n >= 2) & tiny).alias("doubtful")).join(of("a"), "a").join(of("b"), "b")
    found = materialize(found.select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), "corr", "doubtful"))
    doubtful = found.where("doubtful").select("a", "b")
    if doubtful.limit(1).count() == 0:
        return found.select("a", "b", "corr")
    present = values.select(*keys, F.col(name).cast("string").alias("s"), clean("value").alias("v")).where("v is not null")
    left = present.select(*keys, F.col("s").alias("a"), F.col("v").alias("x")).join(doubtful, "a")
    both = left.join(present.select(*keys, F.col("s").alias("b"), F.col("v").alias("y")), [*keys, "b"])
    exact = both.groupBy("a", "b").agg(pair_corr(F.col("x"), F.col("y")).alias("corr"))
    return found.where("not doubtful").select("a", "b", "corr").unionByName(exact)


def complete_covariance(values: DataFrame, keys: Sequence[str], name: str, most: int) -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """Names, covariance matrix, which series vary, and number of the keys on which every series has a value.

    The k x k matrix goes to the driver; more than ``most`` series raise before anything is collected.
    """
    named = series_means(values, name)
    names, means = [n for n, _ in named], [m for _, m in named]
    k = len(names)
    if k > most:
        raise ValueError(f"more than {most} series")
    if not k:
        return names, np.zeros((0, 0)), np.zeros(0, bool), 0
    arrays = key_arrays(values, keys, name, names).where(F.size("cells") == k)
    arrays = materialize(arrays)
    shift = np.array(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(k), np.zeros((k, k))
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                x, _ = _dense(whole.column("cells").slice(at, 2_000), shift)
                n += len(x)
                total += x.sum(0)
                product += x.T @ x
                low, high = np.minimum(low, x.min(0, initial=np.inf)), np.maximum(high, x.max(0, initial=-np.inf))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array([n] * k, pa.int64()), pa.array(total), pa.array(low), pa.array(high), pa.array(product.tolist(), pa.list_(pa.float64()))], ["i", "n", "total", "low", "high", "product"])

    partial = arrays.select("cells").mapInArrow(run, "i int, n long, total double, low double, high double, product array<double>")
    one = partial.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    cells = partial.select("i", F.posexplode("product").alias("j", "p")).where("i <= j").groupBy("i", "j").agg(F.sum("p").alias("p"))
    cov, varies, total, n = np.zeros((k, k)), np.zeros(k, bool), np.zeros(k), 0
    for r in one.collect():
        n, total[r["i"]], varies[r["i"]] = r["n"], r["total"], r["low"] < r["high"]
    for r in cells.collect():
        cov[r["i"], r["j"]] = cov[r["j"], r["i"]] = r["p"]
    if n:
        cov = cov / n - np.outer(total, total) / n**2
    return names, cov, varies, n


def inflation(cov: np.ndarray, varies: np.ndarray) -> np.ndarray:
    """1 / (1 - R2) of each series on all others, from one factorisation; NaN for a constant, inf from R2 = 0.999999.

    The inverse correlation matrix has these factors on its diagonal. Where the matrix is singular, a series that takes
    part in a linear dependence is inflated without bound, the others keep the diagonal of the pseudo-inverse.
    """
    out = np.full(len(cov), np.nan)
    own = np.flatnonzero(varies)
    if not len(own):
        return out
    scale = np.sqrt(np.diag(cov)[own])
    values, vectors = np.linalg.eigh(cov[np.ix_(own, own)] / np.outer(scale, scale))
    null = values <= len(own) * 1e-12
    factor = (vectors[:, ~null] ** 2 / values[~null]).sum(1)
    dependent = (vectors[:, null] ** 2).sum(1) > 1e-9
    out[own] = np.where(dependent | (factor >= 1e6), np.inf, np.maximum(factor, 1.0))
    return out
