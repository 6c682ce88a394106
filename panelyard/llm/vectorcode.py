"""Compression of vectors to one byte a part, with LAESA pivots.

A component x is the integer floor(1024 * x), a vector four parts. A part's codebook has up to 256 entries and is improved
by rounds of exact assignment and integer means. Each part's distances to a few fixed pivots (first entries far from each
other) are computed once and written beside it. In every round an entry's distances to the same pivots give, by the
triangle inequality, the lower bound max |d(part, pivot) - d(entry, pivot)|: entries are tried in the order of their
bounds, in growing steps, until the next bound lies above the best distance found. Distances are compared as
integers, ties go to the lower index, and bounds are lowered by more than their rounding error before they prune.

A round sends a task's sums, one row a used entry, never rows; the driver sees the 256 entries of each part.

Defined cases: a null vector, or one with a null, NaN or infinite component, is dropped; null ids stay and come last in
the choice of first entries, repeated ids are told apart by their components; with fewer than 256 rows there are as many
entries; a null label is a label; a vector whose length isn't that of the first or isn't a multiple of four, and a
component beyond +-``REACH``, raise ValueError; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyard.functions.groups import BROADCAST_ROWS
from panelyard.functions.storage import materialize
from panelyard.llm.common import map_arrow

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 4, 256, 4, 8, 1024
#: integers beyond it would leave exact 64-bit distances
REACH = 1 << 21


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and the integer components x of rows whose vector is whole and finite."""
    finite = F.forall(F.col("v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    picked = rows.select(rows[id_col].alias("vec_id"), rows[label_col].alias("label"), rows[vector_col].cast("array<double>").alias("v"))
    return picked.where(F.col("v").isNotNull() & finite).select("vec_id", "label", F.transform("v", lambda x: F.floor(x * float(SCALE))).alias("x"))


def spread_pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries that lie far apart: each next one is the farthest from those before it."""
    chosen = [0]
    near = _square(entries, entries[0])
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, _square(entries, entries[chosen[-1]]))
    return entries[chosen]


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(_square(parts[:, None, :], pivots[None]).astype(np.float64))


def nearest(parts: np.ndarray, from_pivots: np.ndarray, entries: np.ndarray, entries_from_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry (ties: the lower index) and squared distance of each part, and how many distances were evaluated."""
    bound = np.zeros((len(parts), len(entries)))
    for p in range(from_pivots.shape[1]):
        np.maximum(bound, np.abs(from_pivots[:, p, None] - entries_from_pivots[None, :, p]), out=bound)
    bound -= 1e-9 * (1 + max(from_pivots.max(initial=0), entries_from_pivots.max(initial=0)))
    order = bound.argsort(axis=1)
    best = np.full(len(parts), np.iinfo(np.int64).max)  # squared distance and index in one integer
    active, at, step, evaluated = np.arange(len(parts)), 0, 4, 0
    while len(active) and at < len(entries):
        tried = order[active, at:at + step]
        keys = _square(parts[active, None, :], entries[tried]) * ENTRIES + tried
        best[active] = np.minimum(best[active], keys.min(axis=1))
        evaluated += tried.size
        at, step = at + step, step * 2
        if at < len(entries):
            ahead = bound[active, order[active, at]]
            active = active[(ahead <= 0) | (ahead * ahead <= best[active] // ENTRIES)]
    return best % ENTRIES, best // ENTRIES, evaluated


@dataclass
class Codebooks:
    """Entries of each part, an array (parts, entries, width)."""

    entries: np.ndarray
    pivots: np.ndarray

    @classmethod
    def first(cls, vectors: np.ndarray) -> Codebooks:
        entries = vectors.reshape(len(vectors), PARTS, -1).transpose(1, 0, 2)
        return cls(entries, np.stack([spread_pivots(e) for e in entries]))

    def assign(self, vectors: np.ndarray, from_pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        parts, far = vectors.reshape(len(vectors), PARTS, -1), from_pivots.reshape(len(vectors), PARTS, -1)
        for j in range(PARTS):
            index, error, _ = nearest(parts[:, j], far[:, j], self.entries[j], pivot_distances(self.entries[j], self.pivots[j]))
            yield j, parts[:, j], index, error

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(column), -1)


def with_pivot_distances(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The integer vectors, checked, with each part's distances to its pivots, part by part."""
    width = books.entries.shape[0] * books.entries.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            sizes = set(x.value_lengths().to_pylist())
            if sizes - {width}:
                raise ValueError(f"vectors of {width} components expected, found {sorted(sizes)}")
            v = _matrix(x, np.int64)
            if np.abs(v).max(initial=0) > REACH * SCALE:
                raise ValueError(f"components beyond +-{REACH} have no exact distances")
            parts = v.reshape(len(v), PARTS, -1)
            far = np.concatenate([pivot_distances(parts[:, j], books.pivots[j]) for j in range(PARTS)], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * far.shape[1], pa.int32()), pa.array(far.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), x, flat], ["vec_id", "label", "x", "far"])

    return map_arrow(vectors, run, T.StructType([*vectors.schema.fields, T.StructField("far", T.ArrayType(T.DoubleType()))]))


def improve(measured: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the componentwise floored mean of its parts; unused entries stay."""
    width = books.entries.shape[2]
    names = ["part", "entry", "n", *(f"s{i}" for i in range(width))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(books.entries.shape[:2], np.int64)
        sums = np.zeros(books.entries.shape, np.int64)
        for batch in batches:
            if batch.num_rows:
                for j, part, index, _ in books.assign(_matrix(batch.column("x"), np.int64), _matrix(batch.column("far"), np.float64)):
                    np.add.at(n[j], index, 1)
                    np.add.at(sums[j], index, part)
        j, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(e, pa.int32()), pa.array(n[j, e]), *(pa.array(sums[j, e, i]) for i in range(width))], names)

    schema = "part int, entry int, " + ", ".join(f"{c} long" for c in names[2:])
    # sums of all rows may leave 64 bits before they are divided
    totals = map_arrow(measured.select("x", "far"), run, schema).groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]))
    entries = books.entries.copy()
    for r in totals.collect():  # at most ENTRIES rows a part
        entries[r["part"], r["entry"]] = [int(r[c]) // int(r["n"]) for c in names[3:]]
    return Codebooks(entries, books.pivots)


def encode(measured: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over the parts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, total = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            if batch.num_rows:
                for j, _, index, error in books.assign(_matrix(batch.column("x"), np.int64), _matrix(batch.column("far"), np.float64)):
                    code[:, j] = index
                    total += error
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(total)], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType for f in measured.schema}
    fields = [("vec_id", kinds["vec_id"]), ("label", kinds["label"]), ("code", T.StringType()), ("error", T.LongType())]
    return map_arrow(measured, run, T.StructType([T.StructField(*f) for f in fields]))


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code, error of every kept row, and the codebooks (None without rows)."""
    vectors = integer_vectors(rows, id_col, vector_col, label_col)
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    if not seeds:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), None
    widths = {len(r["x"]) for r in seeds}
    if len(widths) > 1 or min(widths) % PARTS:
        raise ValueError(f"vectors of one length, a multiple of {PARTS}, expected; found {sorted(widths)}")
    books = Codebooks.first(np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), -1))
    measured = materialize(with_pivot_distances(vectors, books))
    for _ in range(ROUNDS):
        books = improve(measured, books)
    return encode(measured, books), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """The coded rows with the error summed over their label, nulls together."""
    coded = materialize(coded)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = materialize(by_label.withColumnRenamed("label", "same"))
    side = F.broadcast(by_label) if by_label.count() <= BROADCAST_ROWS else by_label
    return coded.join(side, coded["label"].eqNullSafe(side["same"])).drop("same")
