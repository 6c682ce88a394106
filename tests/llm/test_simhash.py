from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from panelyard.llm import simhash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    every = np.array(sorted(parent), np.uint64)
    for i, f in enumerate(every):
        for g in every[i + 1:][np.bitwise_count(every[i + 1:] ^ f) <= 3]:
            parent[find(int(g))] = find(int(f))
    return {f: find(f) for f in fps}


def same_partition(a, b):
    return len(set(a.values())) == len(set(b.values())) == len({(a[k], b[k]) for k in a})


def test_fingerprints_of_odd_texts():
    for t in (None, "", " \t\n", "One", "one two", "A b C d", "a b " * 5000, "é\x0bÉ x\x1cy", "x" * 100_000):
        assert simhash.fingerprint(None if t is None else t.encode()) == plain_fingerprint(t)


@pytest.mark.parametrize("bucket", [2048, 12])
def test_links_find_all_components(spark, bucket):
    """Also where buckets are dealt again."""
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            f = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4])):
                f ^= 1 << b
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 4))) for _ in range(150)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), bucket)
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in edges.collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    roots = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(edges).collect()}
    assert same_partition({f: roots.get(f, f) for f in fps}, plain_components(fps))


def test_buckets_dealt_again_in_one_pass():
    """The pass over sorted rows hands over every member of a large bucket and no other."""
    import pyarrow as pa

    keys, parts, fps = np.repeat([0, 1, 2], [5, 3000, 4]).astype(np.int32), np.zeros(3009, np.int64), np.arange(3009, dtype=np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i:i + 700]), pa.array(parts[i:i + 700]), pa.array(fps[i:i + 700])], ["key", "part", "fp"]) for i in range(0, 3009, 700)]
    out = pa.Table.from_batches(list(simhash._pair_up(2048)(iter(batches)))).to_pydict()
    assert sorted(b for k, b in zip(out["kind"], out["b"], strict=True) if k == 1) == list(range(5, 3005))
    assert set(out["kind"]) <= {-1, 1}


def test_long_chains_have_one_root(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1002, 1000), (5000, 5000)], "a long, b long")
    roots = dict(simhash.components(edges).collect())
    assert {roots[i] for i in range(301)} == {0} and roots[1002] == roots[1000] == 1000


DOCS = [(3, "a b c d e"), (2, "a b c d e"), (9, None), (8, ""), (7, "  "), (None, "a b c d e"), (None, "lonely words without id"), (None, "lonely words without id"), (5, "quite different text here"), (5, "quite different text here")]


def test_nulls_ties_and_repeated_rows(spark):
    df = spark.createDataFrame([(*d, 1, "x") for d in DOCS], "doc_id long, text string, fp int, component_id string")
    found = simhash.near_duplicates(df).select("doc_id", "component_id").collect()
    assert sorted(found, key=str) == sorted([(3, 2), (2, 2), (None, 2), (9, 7), (8, 7), (7, 7), (None, None), (None, None), (5, 5), (5, 5)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_query_equals_brute_force(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = plain_components(set(fp.values()))
    low = {}
    for i, f in fp.items():
        low[root[f]] = min(i, low.get(root[f], i))
    rows = queries.op3_simhash_pigeonring(spark, sf).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{f:016x}", low[root[f]]) for i, f in fp.items()}
    assert len(rows) == len(texts)
