"""Near copies against brute-force Jaccard components."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_simhash import plain_fingerprint

from panelyard.llm import nearcopies as nc


def shingles(t, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(words[j:j + width]) for j in range(max(1, len(words) - width + 1))}


def plain_similar(texts, width=5, meet=lambda a, b: True):
    """Smallest id of the component of each id, by brute-force Jaccard similarity of 0.8 or more of pairs that meet."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if not 0.8 * len(sets[a]) - 1e-9 <= len(sets[b]) <= 1.25 * len(sets[a]) + 1e-9 or find(a) == find(b) or not meet(a, b):
                continue
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_kept_rows_have_no_similar_partner(spark):
    """Near copies that differ in more bits than SimHash allows go; texts under 0.8 stay, also beside a large group."""
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(500)]
    texts, at = {}, 0
    for _ in range(20):
        base = [rng.choice(vocab) for _ in range(120)]
        for n in (0, 1, 2, 3, 9):
            own = list(base)
            for k in range(n):
                own[5 + 12 * k] = "changed"
            texts[at], at = " ".join(own), at + 1
    base = [rng.choice(vocab) for _ in range(200)]
    for k in range(150):
        own = list(base)
        own[k] = f"other{k}"
        texts[at], at = " ".join(own), at + 1
    root = plain_similar(texts)
    assert any((plain_fingerprint(texts[i]) ^ plain_fingerprint(texts[r])).bit_count() > 3 for i, r in root.items())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nc.keep_one_of_each(df).collect()) == sorted(set(root.values()))


def test_one_id_on_different_texts(spark):
    """Each component keeps its own row, whatever else its id is on."""
    rows = [(1, "first text of the shared id"), (1, "second text of the shared id"), (1, "second text of the shared id"), (2, "Second  text of the shared id"), (0, "third text"), (1, "third text"), (None, "third text"), (None, "no id at all"), (None, "no id at all")]
    kept = nc.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[0], rows[1], rows[4], rows[7]], key=str)


def family(seed, n, slots, values, length=200):
    """Texts of one template whose slots take one of some values each."""
    rng = random.Random(seed)
    base = [f"{seed}w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        own = list(base)
        for s in range(slots):
            own[6 + s * (length - 12) // slots] = f"slot{s}v{rng.randrange(values)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("block", [nc.BLOCK, 20_000])
def test_template_families_in_large_bands(spark, block):
    """Every band holds hundreds of texts and most pairs are not similar: no pair that shares a band is lost, in one block or in many."""
    texts = dict(enumerate([*family(1, 300, 16, 2), *family(2, 250, 10, 4), *family(3, 60, 3, 5)]))
    bands = {i: set(nc.bands_of(nc.shingle_hashes(nc.words_of(t.encode())))) for i, t in texts.items()}
    shared = plain_similar(texts, meet=lambda a, b: bands[a] & bands[b])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in nc.keep_one_of_each(df, block=block).collect()) == sorted(set(shared.values()))
    everything = set(plain_similar(texts).values())
    gone = len(texts) - len(everything)
    assert len(texts) - len(set(shared.values())) >= 0.9 * gone and gone > 100


def test_simhash_finds_candidates(spark):
    """Texts within three bits of each other meet without any MinHash band; the exact check still decides."""
    texts = dict(enumerate([*family(9, 30, 2, 3, 400), *family(10, 2, 1, 2, 12)]))
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in range(a) if 0 < (prints[a] ^ prints[b]).bit_count() <= 3]
    want = plain_similar(texts, meet=lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert near and len(set(want.values())) < len(texts)
    named = nc._named(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    sketched = nc.sketches(named).withColumn("bands", F.expr("cast(array() as array<bigint>)"))
    key_of = {nc.key_of(nc.words_of(t.encode())): i for i, t in texts.items()}
    root = {i: i for i in texts}
    for e in nc.similar(nc.materialize(sketched), named).collect():
        low, high = sorted((root[key_of[e["a"]]], root[key_of[e["b"]]]))
        root = {i: low if r == high else r for i, r in root.items()}
    copies = {i: key_of[nc.key_of(nc.words_of(t.encode()))] for i, t in texts.items()}  # one text has one key
    assert all(root[copies[a]] == root[copies[b]] for a in texts for b in range(a) if want[a] == want[b])


def test_bands_cover_nearly_all_similar_pairs():
    texts = [*family(5, 120, 12, 3), *family(6, 80, 8, 4)]
    sets = [shingles(t) for t in texts]
    bands = [set(nc.bands_of(nc.shingle_hashes(nc.words_of(t.encode())))) for t in texts]
    alike = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(alike) > 300 and sum(bool(bands[a] & bands[b]) for a, b in alike) >= 0.99 * len(alike)


def test_block_edges_join_components_only():
    rng = np.random.default_rng(4)
    shingles_ = [np.unique(rng.integers(0, 30, 25)).astype(np.int64) for _ in range(60)]
    keys, comps = np.arange(60), np.where(np.arange(60) < 20, 0, np.arange(60))
    a, b = nc.block_edges(keys, comps, comps != 0, shingles_, 0.8)
    root = {i: (0 if i < 20 else i) for i in range(60)}
    for x, y in zip(a, b, strict=True):
        sx, sy = set(shingles_[x].tolist()), set(shingles_[y].tolist())
        assert len(sx & sy) >= 0.8 * len(sx | sy) and root[x] != root[y]
        root = {i: root[x] if r == root[y] else r for i, r in root.items()}
    for x in range(60):
        for y in range(20, 60):
            sx, sy = set(shingles_[x].tolist()), set(shingles_[y].tolist())
            assert root[x] == root[y] or len(sx & sy) < 0.8 * len(sx | sy)


def test_odd_rows_and_clashing_columns(spark):
    cols = ["doc_id", "text", "row", "raw", "key", "__id", "__text_key", "its_id", "size", "repeated"]
    rows = [(3, "A b c d e"), (2, "a b  c d e"), (None, "a b c d e"), (9, None), (8, ""), (7, "  "), (None, "lonely words without id"), (None, "lonely words without id"), (5, "quite different text here"), (5, "quite different text here"), (6, "w " * 60_000), (4, "w " * 50_000)]
    df = spark.createDataFrame([(*r, *(f"{c}{r[0]}" for c in cols[2:])) for r in rows], cols)
    kept = nc.keep_one_of_each(df)
    assert kept.columns == cols
    assert sorted(map(tuple, kept.select("doc_id", "text", "__id", "raw").collect()), key=str) == sorted([(i, t, f"__id{i}", f"raw{i}") for i, t in (rows[1], rows[5], rows[6], rows[8], rows[11])], key=str)


def test_empty_table(spark):
    assert nc.keep_one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_large_sides_are_dealt_instead_of_broadcast(spark, monkeypatch):
    texts = [(i, t) for i, t in enumerate([*family(7, 40, 2, 3), *family(8, 5, 1, 1)])] + [(None, "words of no id"), (None, "words of no id")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(tuple, nc.keep_one_of_each(df).collect()), key=str)
    monkeypatch.setattr(nc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, nc.keep_one_of_each(df).collect()), key=str) == want and len(want) < 25
