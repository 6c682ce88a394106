"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits in eight segments on a ring. If two differ in at most 3 bits, some start segment has every
chain of l consecutive segments from it within l * 3 / 8 differing bits: the first two segments are equal, the first
five differ in one bit, the first seven in two. So two of the third to fifth segments are equal as well, which gives
3 keys of four equal segments (32 bits) for each of 8 starts. Distinct fingerprints meet by key, chains are checked
before the full Hamming distance, and each bucket yields the edges of a spanning forest instead of all pairs.

A bucket of more than ``BUCKET`` fingerprints is dealt again: its free 32 bits form a ring of eight 4-bit segments with
24 finer keys, whose buckets share 48 bits and so can't exceed 65,536 distinct fingerprints, however many rows there
are. Components then follow from alternating star contractions of written edge tables.

Defined cases: a null, empty or blank text has fingerprint zero and links like any other; repeated rows stay, each with
the same component; a null id never is a component's id unless all its ids are null; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize
from panelyard.llm.common import ASCII_LOWER, id_and_text, map_arrow

BITS, SEGMENTS, LIMIT = 64, 8, 3
BUCKET = 2048
_BLOCK = 1 << 16
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of ``width`` words of a whole text, as an unsigned integer."""
    return fingerprint_of((text or b"").translate(ASCII_LOWER).split(), width, seed)


def fingerprint_of(words: list[bytes], width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's words, lower-cased already."""
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        block = words[at:at + _BLOCK + width - 1]
        shingles = zip(*(block[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
        hashes = np.fromiter((digest(b" ".join(s), seed) for s in shingles), np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[8 * j:8 * j + 8] += np.bincount(octets[:, j], minlength=256) @ _BIT_OF_BYTE
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long), a row per row."""
    docs = id_and_text(docs, id_col, text_col)
    schema = docs.select("doc_id", F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary() if pa.types.is_string(batch.column("text").type) else pa.large_binary())
            fps = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs, run, schema)


def _ring_masks(groups: list[int], lengths: tuple[int, ...]) -> list[tuple[int, int]]:
    """(mask, differing bits allowed) of the chains of these lengths over segments given as masks, from the first on."""
    out = []
    for n in lengths:
        mask = 0
        for g in groups[:n]:
            mask |= g
        out.append((mask, n * LIMIT // SEGMENTS))
    return out


def _keys_of(segments: list[int]) -> list[tuple[int, int]]:
    """(start, mask of four segments) of the 24 keys over a ring of eight segments."""
    ring = [segments[i:] + segments[:i] for i in range(SEGMENTS)]
    return [(i, r[0] | r[1] | r[2 + a] | r[2 + b]) for i, r in enumerate(ring) for a, b in ((0, 1), (0, 2), (1, 2))]


_OCTETS = [0xFF << 8 * i for i in range(8)]
_COARSE = _keys_of(_OCTETS)


def _nibbles(taken: int) -> list[int]:
    """4-bit segments of the bits that a coarse key leaves free."""
    return [0xF << 4 * i for i in range(16) if not taken >> 4 * i & 0xF]


def _chains(key: int) -> list[tuple[int, int]]:
    start = _COARSE[key][0]
    return _ring_masks(_OCTETS[start:] + _OCTETS[:start], (5, 7))


_CHAINS = [_chains(k) for k in range(len(_COARSE))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _linked(a: np.ndarray, b: np.ndarray, chains: list[tuple[int, int]]) -> np.ndarray:
    """Which pairs differ in at most LIMIT bits; chains drop most before the whole is counted."""
    x = a ^ b
    good = np.ones(x.shape, bool)
    for mask, most in chains:
        good &= np.bitwise_count(x & np.uint64(mask)) <= most
    good[good] = np.bitwise_count(x[good]) <= LIMIT
    return good


def _forest(fps: np.ndarray, chains: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of one bucket: every fingerprint is reached once."""
    left, right, rest = [], [], np.arange(len(fps))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = _linked(fps[rest], fps[node], chains)
            if near.any():
                found = rest[near].tolist()
                left += [node] * len(found)
                right += found
                queue += found
                rest = rest[~near]
    return left, right


def _bucket_edges(bounds: np.ndarray, fps: np.ndarray, keys: np.ndarray, chained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside consecutive buckets that begin at ``bounds``: small ones pair by pair, all at once, others by forest."""
    sizes = np.diff(np.append(bounds, len(fps)))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(small)
    for d in range(1, 8):
        at = at[at + d < len(fps)]
        at = at[run[at] == run[at + d]]
        if not len(at):
            break
        if chained:
            good = np.zeros(len(at), bool)
            for k in np.unique(keys[at]):
                own = keys[at] == k
                good[own] = _linked(fps[at[own]], fps[at[own] + d], _CHAINS[k])
        else:
            good = _linked(fps[at], fps[at + d], [])
        left.append(fps[at[good]])
        right.append(fps[at[good] + d])
    for r in np.flatnonzero(sizes > 8):
        own = fps[bounds[r]:bounds[r] + sizes[r]]
        a, b = _forest(own, _CHAINS[keys[bounds[r]]] if chained else [])
        left.append(own[a] if a else own[:0])
        right.append(own[b] if b else own[:0])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _pair_up(most: int | None):
    """mapInArrow over rows sorted by bucket: rows (kind, a, b) are edges (-1), or members of a bucket of more than ``most`` (its key, the fingerprint); without ``most`` buckets have finer keys and none is too large."""

    def rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "a", "b"])

    def settle(keys: np.ndarray, parts: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fps):
            return
        bounds = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))))
        a, b = _bucket_edges(bounds, fps, keys, most is not None)
        if len(a):
            yield rows(np.full(len(a), -1), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, fps = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        large: tuple[int, int] | None = None
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False)))
            parts = np.concatenate((parts, batch.column("part").to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            while len(fps):
                if large is not None:  # the bucket that was found too large goes on
                    own = (keys == large[0]) & (parts == large[1])
                    if own.any():
                        yield rows(np.full(own.sum(), large[0]), fps[own], fps[own])
                        keys, parts, fps = keys[~own], parts[~own], fps[~own]
                    if len(fps):
                        large = None
                    continue
                last = int(np.argmax((keys == keys[-1]) & (parts == parts[-1])))  # first row of the last bucket
                starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1]))))
                sizes = np.diff(np.append(starts, len(fps)))
                if most is not None and (sizes > most).any():
                    s, n = next((s, n) for s, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n > most)
                    yield from settle(keys[:s], parts[:s], fps[:s])
                    large = (int(keys[s]), int(parts[s]))
                    keys, parts, fps = keys[s:], parts[s:], fps[s:]
                    continue
                yield from settle(keys[:last], parts[:last], fps[:last])
                keys, parts, fps = keys[last:], parts[last:], fps[last:]
                break
        yield from settle(keys, parts, fps)

    return run


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "part").sortWithinPartitions("key", "part")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect just what fingerprints ``fp`` within LIMIT bits of each other connect."""
    schema = "kind int, a long, b long"
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for k, (_, m) in enumerate(_COARSE)])).alias("k"))
    first = materialize(map_arrow(_dealt(keyed.select("k.key", "k.part", "fp")), _pair_up(bucket), schema))
    finer = F.lit(None).cast("array<struct<key:int,part:bigint>>")
    for k, (_, m) in enumerate(_COARSE):
        fine = _keys_of(_nibbles(m))
        finer = F.when(F.col("kind") == k, F.array(*[F.struct(F.lit(100 * k + j).alias("key"), F.col("b").bitwiseAND(F.lit(_signed(m | s))).alias("part")) for j, (_, s) in enumerate(fine)])).otherwise(finer)
    again = first.where("kind >= 0").select(F.col("b").alias("fp"), F.explode(finer).alias("k"))
    second = map_arrow(_dealt(again.select("k.key", "k.part", "fp")), _pair_up(None), schema)
    return first.where("kind < 0").unionByName(second).select("a", "b").distinct()


def _signature(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (a, b): the smallest node reachable, by alternating large and small stars.

    Each round is written, so its lineage is cut and lost executors cost no earlier round. Minima are aggregated before
    the exchange; a hub's edges are a skewed side of a join, which adaptive execution splits.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = materialize(both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def print_roots(distinct: DataFrame) -> DataFrame:
    """(node, root) for the fingerprints ``fp`` that link with others: the smallest fingerprint reachable."""
    return materialize(components(links(distinct)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (smallest id of the component), root (the component's smallest fingerprint), a row per row."""
    prints = materialize(fingerprints(docs, id_col, text_col))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = print_roots(distinct)
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = materialize(rooted.join(named, "root").select("fp", "component_id", "root"))  # a written side lets a hot fingerprint be split
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id", "root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
