from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from panelyard.llm import sharding

SCHEMA = "doc_id long, text string"


def shards(spark, rows, n=4, schema=SCHEMA):
    return sharding.shard_rows(spark.createDataFrame(rows, schema), n).collect()


def check(rows, found, n):
    assert sorted((r["doc"]["doc_id"], r["doc"]["text"]) for r in found if r["doc"]["doc_id"] is not None) == sorted((i, t) for i, t in rows if i is not None) or any(t is None for _, t in rows)
    assert len(found) == len(rows)
    by = {}
    for r in found:
        assert r["size"] == len((r["doc"]["text"] or "").encode()) + 1
        by.setdefault(r["shard"], []).append(r)
    assert all(0 <= s < n for s in by)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_bytes_are_near_equal_and_slots_gapless(spark):
    rows = [(i, "ä" * (i * 37 % 200)) for i in range(2000)]
    sizes = check(rows, shards(spark, rows, 8), 8)
    ideal = sum(len(t.encode()) + 1 for _, t in rows) / 8
    assert all(abs(s - ideal) <= 0.003 * ideal + 400 for s in sizes.values()) and len(sizes) == 8


def test_a_hot_text_is_divided_by_id(spark):
    rows = [(i, "same text for a third of all rows") for i in range(900)] + [(10_000 + i, f"other {i} " * 4) for i in range(900)]
    sizes = check(rows, shards(spark, rows, 6), 6)
    assert max(sizes.values()) - min(sizes.values()) <= 120


def test_equal_texts_lie_side_by_side(spark):
    rows = [(i, f"text {i % 50}") for i in range(500)]
    found = sorted(shards(spark, rows, 4), key=lambda r: (r["shard"], r["slot"]))
    changes = sum(a["doc"]["text"] != b["doc"]["text"] for a, b in zip(found, found[1:], strict=False))
    assert changes == 49


def test_wide_ids_nulls_ties_and_empty_tables(spark):
    rows = [(None, None), (None, "x"), (-(2**63) + 1, "x"), (2**63 - 1, "x"), (5, ""), (5, ""), (7, "y" * 5000)] + [(i, "x") for i in range(100)]
    check(rows, shards(spark, rows, 3), 3)
    assert shards(spark, [], 3) == []
    assert len(shards(spark, [(1, "only")], 16)) == 1


def test_extra_columns_with_clashing_names_travel_along(spark):
    df = spark.createDataFrame([(1, "a", 9, 8, 7), (2, "bb", 6, 5, 4)], "doc_id long, text string, shard int, size int, k_hash int")
    found = sharding.shard_rows(df, 2).select("doc.*").orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == [(1, "a", 9, 8, 7), (2, "bb", 6, 5, 4)]


def test_splitters_meet_the_tolerance(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("k_hash"), F.col("id").alias("k_id"), (F.col("id") % 100 + 1).alias("size"))
    found = sharding.find_splitters(keys, 10, tolerance=0.01, probes=16)
    total = keys.agg(F.sum("size")).first()[0]
    for i, s in enumerate(found, 1):
        below = keys.where(~s.right(F.col("k_hash"), F.col("k_id"))).agg(F.sum("size")).first()[0]
        assert below == pytest.approx(total * i / 10, abs=0.01 * total / 10)


def test_query(spark):
    from panelyard.llm import queries

    rows = queries.op1_histogram_sort_shards(spark, "/root/testdata/sf0.001").collect()
    texts = dict(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect())
    assert {r["doc_id"] for r in rows} == set(texts) and {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in rows)


def test_query_row_by_row(spark):
    """Rows lie in the order of text hash and id, whole, gapless in each shard, and cuts are within a row of equal bytes."""
    import xxhash

    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    signed = lambda n: n - (n >> 63 << 64)
    size = {i: len((t or "").encode()) + 1 for i, t in docs}
    order = [i for _, i in sorted((signed(xxhash.xxh64_intdigest(t.encode(), 42)) if t is not None else 42, i) for i, t in docs)]
    rows = sorted(queries.op1_histogram_sort_shards(spark, sf).collect(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["doc_id"] for r in rows] == order and all(r["size"] == size[r["doc_id"]] for r in rows)
    total, below = sum(size.values()), 0
    for shard in range(16):
        own = [r for r in rows if r["shard"] == shard]
        assert [r["slot"] for r in own] == list(range(len(own)))
        below += sum(r["size"] for r in own)
        assert abs(below - total * (shard + 1) / 16) <= max(size.values()) + 0.001 * total / 16
