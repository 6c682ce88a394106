"""Token files and their index (tokenizers library), pieces (sentencepiece library)."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelyard.llm import pieces, tokenfile

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def random_texts(n, seed=3):
    rng = random.Random(seed)
    bits = ["a", "e", "the", "ing", " ", "  ", "    ", "\n", "\t", "▁", "é", "é", "☃", "𝒳", "1", "200", "!!", "\x00", "\x1c", " ", " ", "İ", "Σ", "'s", "'LL", "<|endoftext|>", "xq", "ﬁ"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_chunks_encode_like_whole_texts():
    enc, whole = tokenfile.Encoder(WORDS), Tokenizer.from_file(WORDS)
    texts = [*random_texts(3000), None, "", "a" * 3000]
    for t, raw in zip(texts, enc.encode(texts, 2), strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == whole.encode(t or "", add_special_tokens=False).ids + [2], repr(t)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a = rng.choice(2**40, n, replace=False).astype(np.uint64)
    b = rng.integers(0, 3, n).astype(np.uint64)
    slots = tokenfile.PerfectHash.build(a, b).slots(a, b)
    assert sorted(slots.tolist()) == list(range(n))


def test_foreign_keys_are_told_by_fingerprint():
    ids, occ = pa.array([*range(5000)], pa.int64()), pa.array([0] * 5000, pa.int64())
    a, b = tokenfile._key_words(ids, occ)
    mph = tokenfile.PerfectHash.build(a, b)
    held = np.zeros(5000, np.uint32)
    held[mph.slots(a, b)] = tokenfile._fingerprint(a, b)
    other = tokenfile._key_words(pa.array([*range(10_000, 15_000)], pa.int64()), occ)
    slot = mph.slots(*other)
    assert not ((slot >= 0) & (held[slot] == tokenfile._fingerprint(*other))).any()


ROWS = [(5, "Hello there"), (2, None), (-7, ""), (5, "again five"), (None, "no id"), (None, "none either"), (100, "ü é " * 4000), (3, "x"), (3, "x")]


def test_files_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, 2) for r in ROWS], "doc_id long, text string, n long, start string")
    written = tokenfile.TokenFiles(df, WORDS, end=2)
    found = sorted(map(tuple, written.read(tokenfile.keys_of(df)).collect()), key=lambda r: r[2])
    whole = Tokenizer.from_file(WORDS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in found] == [r[0] for r in order]
    ids = {t: whole.encode(t or "", add_special_tokens=False).ids + [2] for _, t in ROWS}
    assert sorted((r[0], r[3], r[4]) for r in found if r[0] is not None) == sorted((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for i, t in ROWS if i is not None)
    starts = np.cumsum([0] + [r[3] for r in found])[:-1]
    assert [r[2] for r in found] == starts.tolist()
    absent = spark.createDataFrame([(99, 0), (5, 2), (5, 1)], "doc_id long, occ long")
    assert [(r[0], r[1]) for r in written.read(absent).collect()] == [(5, 1)]


def test_files_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    written = tokenfile.TokenFiles(df, WORDS, end=2)
    assert written.read(tokenfile.keys_of(df)).collect() == []


def test_query_equals_library(spark):
    from panelyard.llm import queries

    sf, whole, start = "/root/testdata/sf0.001", Tokenizer.from_file(WORDS), 0
    found = {r["doc_id"]: r for r in queries.op5_perfect_hash_token_files(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert len(found) == len(docs)
    for d, t in docs:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(found[d]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_equal_library(library):
    own = pieces.load(PIECES)
    for t in [*random_texts(5000, 9), "x" * 700, "the " * 300, "ab▁▁c  d", "\n\nA b\n c\n"]:
        ids = library.encode(t, add_eos=True)
        assert own.encode(t).tolist() == ids, repr(t)
        assert own.decode(own.encode(t)) == library.decode(ids), repr(t)
    assert own.encode(None).tolist() == [2] and own.decode(own.encode(None)) == ""


def test_any_ids_decode_like_the_library(library):
    rng, own = random.Random(1), pieces.load(PIECES)
    for _ in range(2000):
        ids = [rng.randint(3, 300) if rng.random() < 0.5 else rng.randint(3, 31_999) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, np.int32)) == library.decode(ids), ids


def test_pieces_of_odd_rows(spark, library):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, ids string")
    found = sorted(map(tuple, pieces.encode_decode(df, PIECES).collect()), key=str)
    assert found == sorted(((i, library.encode(t or "", add_eos=True), t or "") for i, t in ROWS), key=str)
    assert pieces.encode_decode(df.where("false"), PIECES).collect() == []


def test_pieces_query(spark, library):
    import hashlib

    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for d, t in texts.items():
        ids = library.encode(t or "", add_eos=True)
        want.add((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))))
    assert set(map(tuple, queries.op7_prefix_table_pieces(spark, sf).collect())) == want


def test_other_tokenizers_get_whole_texts():
    """A byte-level tokenizer keeps white space and case: the chunks' way is for files that say they drop both."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, whole = tokenfile.Encoder(path), Tokenizer.from_file(path)
    texts = ["The cat  sat", " leading", "Tab\tand\nline", "", None, "ÀÉ naïve \u00a0 x", "word " * 3000, "it's <|endoftext|> here"]
    assert not enc.chunked and tokenfile.Encoder(WORDS).chunked
    for t, blob in zip(texts, enc.encode(texts, 2), strict=True):
        assert np.frombuffer(blob, enc.dtype).tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2]


def test_settings_that_rule_out_chunks():
    import json

    plain = json.loads(Tokenizer.from_file(WORDS).to_str())
    assert tokenfile.cuts_at_white_space(json.dumps(plain))
    for change in ({"normalizer": None}, {"pre_tokenizer": None}, {"model": {**plain["model"], "dropout": 0.1}}, {"truncation": {"max_length": 5}}, {"added_tokens": [{**plain["added_tokens"][0], "lstrip": True}]}):
        assert not tokenfile.cuts_at_white_space(json.dumps({**plain, **change}))


def test_an_id_on_many_rows_fills_several_files(spark):
    """Rows of one id, and of no id, are dealt over tasks; their occurrences count on from file to file."""
    rows = [(7, f"w{i % 50} text") for i in range(400)] + [(None, "same text")] * 300 + [(i, f"own {i}") for i in range(20)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        written = tokenfile.TokenFiles(df, WORDS, end=2)
        files = {r["part"] for r in written.entries.where("doc_id = 7").select("part").collect()}
        entries = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["occ"]) for r in written.entries.collect()))
        found = written.read(tokenfile.keys_of(df)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)
    assert len(files) > 1 and len(entries) == len(set(entries)) == len(found) == 720
    assert [e[2] for e in entries if not e[0]] == list(range(300)) and [o for _, d, o in entries if d == 7] == list(range(401))
    by_start = sorted(found, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *(r["n"] for r in by_start)])[:-1].tolist()
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in by_start]
    assert order == sorted(order)
