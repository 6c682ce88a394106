from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from panelyard.llm import language


def substrings(t):
    return {t[i:j] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


def test_automaton_knows_just_the_substrings():
    rng = random.Random(2)
    for _ in range(30):
        text = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
        rows, known = language.automaton(text), substrings("".join(map(str, text)))
        moves = language.Moves.of(rows, 3)
        for n in range(1, 6):
            for code in range(3**n):
                word, state = [code // 3**i % 3 for i in range(n)], 0
                for c in word:
                    state = int(moves.step(np.array([state]), np.array([c]))[0]) if state >= 0 else -1
                assert (state >= 0) == ("".join(map(str, word)) in known)


def phrases(text, sample):
    """Greedy parse of blocks by substring search."""
    total = 0
    for at in range(0, len(text), language.BLOCK):
        block, begin, n = text[at:at + language.BLOCK], 0, 0
        while begin < len(block):
            end = begin + 1
            while end < len(block) and block[begin:end + 1] in sample:
                end += 1
            begin, n = end, n + 1
        total += n
    return total


def test_entropies_equal_a_plain_parse():
    samples = {"a": "the cat sat on the mat and the dog sat too", "b": "le chat et le chien sont assis sur le tapis"}
    model = language.Model(samples)
    texts = ["the dog and the cat", "le chien", "xyz the", "chat " * 200, "q"]
    texts = [language.normalise(t) for t in texts]
    found = model.entropies(texts)
    for i, t in enumerate(texts):
        for k, lang in enumerate("ab"):
            assert abs(found[i, k] - phrases(t, samples[lang]) * model.cost[k] / len(t)) < 1e-9


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")


def rows_of(n=60):
    rng = random.Random(4)
    vocab = {"aa": ["kalo", "miru", "tepa", "sona"], "bb": ["grux", "zwarp", "blenk", "frosk"]}
    return [(i, " ".join(rng.choice(vocab[g]) for _ in range(30)), g, 1, "x") for i in range(n) for g in ["aa" if i % 2 else "bb"]]


def test_odd_rows(spark):
    odd = [(1000, None, "aa", 1, ""), (1001, "", None, 1, ""), (1002, "12 34 !!", "bb", 1, ""), (None, "kalo miru", "bb", 1, ""), (1003, "ZWARP! " * 5000, None, 1, ""), (1003, "ZWARP! " * 5000, None, 1, "")]
    found = [tuple(r) for r in language.identify(table(spark, rows_of() + odd)).collect()]
    by = {r[0]: r[1] for r in found}
    assert len(found) == 66 and by[1000] == by[1001] == by[1002] == "und" and by[None] == "aa" and by[1003] == "bb"
    assert all(by[i] == g for i, _, g, _, _ in rows_of()) and all(0 <= r[2] <= 1 for r in found)
    kept = language.keep_identified(table(spark, rows_of() + odd))
    assert kept.columns == ["doc_id", "text", "lang", "score", "lang_pred"] and kept.count() == 63


def test_nothing_to_learn_from_and_empty_tables(spark):
    assert [r[1] for r in language.identify(table(spark, [(1, "word", None, 1, "")])).collect()] == ["und"]
    assert language.identify(table(spark, [])).collect() == []


def test_held_out_rows_are_not_learnt_from(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2][:5]
    docs = table(spark, [(i, "secret words", "cc", 1, "") for i in held] + rows_of(20))
    assert "cc" not in language.sample(docs.select("doc_id", "text", "lang"))


def test_query_accuracy_on_held_out_rows(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op4_cross_parsing_language(spark, sf).join(truth, "doc_id").where("held_out").agg(F.count("*").alias("n"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("ok")).first()
    assert rows["n"] > 150 and rows["ok"] > 0.97


def test_texts_stay_where_there_is_no_model(spark):
    rows = [(1, "some words", None, 1, ""), (2, "12 !!", None, 1, ""), (3, None, None, 1, "")]
    assert [r["doc_id"] for r in language.keep_identified(table(spark, rows)).collect()] == [1]


def test_large_alphabets_keep_all_letters():
    """Two languages of one alphabet of 900 letters: each letter is a symbol, so texts are told apart."""
    rng = random.Random(7)
    han = [chr(0x4E00 + i) for i in range(900)]
    words = {g: ["".join(rng.choice(han) for _ in range(rng.randint(1, 3))) for _ in range(300)] for g in "ab"}
    text = lambda g, n: " ".join(rng.choice(words[g]) for _ in range(n))
    model = language.Model({g: text(g, 6000) for g in "ab"})
    assert max(len(m.owner) for m in model.moves) < 120_000
    for g in "ab":
        found, scores = model.predict([text(g, 20) for _ in range(50)])
        assert set(found) == {g} and scores.min() > 0
    texts = [language.normalise(text("a", 60) + " latin words " + text("b", 5))]
    plain = [phrases(texts[0], model.samples[g]) for g in "ab"]
    assert model.phrases(texts)[0][0].tolist() == plain


def test_the_parse_decides_what_stays():
    """Texts of a learnt language stay, also short and mixed ones; random letters and other languages go."""
    rng = random.Random(5)
    stems = ["ka", "lo", "mi", "ru", "te", "pa", "so", "na"]
    word = lambda: "".join(rng.choice(stems) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    model = language.Model({"aa": language.normalise(text(6000))[:20_000]})
    model.calibrate({"aa": [text(150) for _ in range(40)]})
    clean = [text(rng.choice([1, 2, 5, 20, 100, 400])) for _ in range(400)]
    assert 0 < model.usual["aa"] < 1 and all(model.belongs(clean))
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)) for _ in range(20)]
    assert not any(model.belongs(noise)) and model.belongs([None, "", "12 !"]) == [False] * 3


def test_share_of_held_out_rows_that_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in language.keep_identified(docs).select("doc_id").collect()}
    rows = [r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(rows) > 150 and sum(i in kept for i in rows) >= 0.98 * len(rows)


def test_query_row_by_row(spark):
    """Every text of the table by a plain greedy parse of its own: the same language and score."""
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    samples = language.sample(docs.select("doc_id", "text", "lang"))
    cost = {g: float(np.log2(max(2, len(s)))) for g, s in samples.items()}
    found = {r["doc_id"]: (r["lang_pred"], r["score"], r["held_out"]) for r in queries.op4_cross_parsing_language(spark, sf).collect()}
    assert len(found) == docs.count() and len(samples) == 4
    for i, t in docs.select("doc_id", "text").collect():
        n = language.normalise(t)
        held = zlib.crc32(str(i).encode()) % 4 == 2
        if not n:
            assert found[i] == ("und", 0.0, held)
            continue
        bits = sorted((phrases(n, samples[g]) * cost[g], g) for g in sorted(samples))
        assert found[i][0] == bits[0][1] and abs(found[i][1] - (1 - bits[0][0] / bits[1][0])) < 1e-9 and found[i][2] == held
