"""Vector codes against plain exhaustive assignment in Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from panelyard.llm import vectorcode as vc


def brute(rows, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * width:(p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:256]
    books = [[cut(v, p) for _, v, _ in first] for p in range(4)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        fresh = []
        for p in range(4):
            of = {}
            for _, v, _ in kept:
                of.setdefault(near(v, p)[1], []).append(cut(v, p))
            fresh.append([[sum(c) // len(of[i]) for c in zip(*of[i])] if i in of else e for i, e in enumerate(books[p])])
        books = fresh
    coded = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(4)), sum(near(v, p)[0] for p in range(4)), label) for i, v, label in kept]
    total = {}
    for _, _, e, label in coded:
        total[label] = total.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, total[label], sha) for i, c, e, label in coded), key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "vec_id long, embedding array<float>, label int, error int, code string, far double")
    coded, books = vc.compress(df)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], books.sha256()) for r in vc.with_label_error(coded).collect()), key=str)


def vectors(n, width=8, seed=3, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, scale, width).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]


ODD = [(None, [0.1] * 8, None), (None, [0.1] * 8, None), (1, None, 1), (2, [0.1] * 7 + [None], 1), (3, [float("nan")] + [0.0] * 7, 1), (4, [float("inf")] + [0.0] * 7, 2), (5, [-0.0001] * 8, 1), (5, [-0.0001] * 8, 1), (5, [0.3] * 8, None)]


@pytest.mark.parametrize("rows", [vectors(330), vectors(40, 4), ODD, ODD + vectors(300), [(i % 50, [0.5] * 8, 0) for i in range(300)], [(1, [], 1), (2, [], 1)], vectors(300, 8, 4, 0.002)])
def test_equals_brute_force(spark, rows):
    want = brute(rows)
    assert found(spark, rows) == want and want


def test_pruning_loses_nothing_and_saves_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-4000, 4000, (32, 4))
    entries = (centres[rng.integers(0, 32, 256)] + rng.integers(-50, 50, (256, 4))).astype(np.int64)
    parts = (centres[rng.integers(0, 32, 500)] + rng.integers(-50, 50, (500, 4))).astype(np.int64)
    entries[200:] = entries[:56]  # ties: the lower index
    pivots = vc.spread_pivots(entries)
    index, error, evaluated = vc.nearest(parts, vc.pivot_distances(parts, pivots), entries, vc.pivot_distances(entries, pivots))
    far = ((parts[:, None] - entries[None]) ** 2).sum(-1)
    assert (index == far.argmin(1)).all() and (error == far.min(1)).all() and index.max() < 200
    assert evaluated < 0.25 * far.size


def test_bad_vectors_raise(spark):
    for rows in ([(1, [0.1] * 6, 1)], [(1, [0.1] * 4, 1), (2, [0.1] * 8, 1)], [(i, [0.1] * 4, 1) for i in range(300)] + [(999, [0.1] * 8, 1)], [(1, [1e30] * 4, 1)]):
        with pytest.raises(Exception, match="expected|exact distances"):
            found(spark, rows)


def test_empty_table(spark):
    coded, books = vc.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert books is None and vc.with_label_error(coded).collect() == []


def test_query(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in queries.op12_pivot_vector_codes(spark, sf).collect()), key=str)
    assert got == brute(rows)
