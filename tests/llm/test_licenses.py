from __future__ import annotations

import random
import re

from panelyard.llm import licenses


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(t, threshold=licenses.THRESHOLD):
    w = words(t)
    places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split())
    half = max(len(x.split()) for x in licenses.TEMPLATES.values())
    blocks = []
    for b in range(max(1, -(-len(w) // half)) if w else 0):
        block = w[b * half:(b + 2) * half]
        for label, x in licenses.TEMPLATES.items():
            tokens = set(x.split())
            if len(tokens & set(block)) >= threshold * len(tokens) - 1e-9 and set(licenses.NAMES.get(label, "").split()) <= set(block):
                blocks.append((b * half, min(len(w), (b + 2) * half), label, len(tokens & set(block)) / len(tokens)))
    return len(w), places, sorted(blocks)


TEXTS = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "CC BY cc-by CC\nBY"), (5, "x " * 70 + licenses.TEMPLATES["bsd-redistribution"] + " y" * 70),
    (6, "This work is licensed under the GNU General Public License, version 3. " * 3), (7, "apache é license"), (None, "the MIT license"), (8, "word " * 30_000 + "Apache License"), (8, "word " * 30_000 + "Apache License"),
    (9, "Permission granted free of charge to any person obtaining a copy of this software and documentation"),
]


def random_texts(n=300):
    rng = random.Random(8)
    vocab = sorted({w for x in licenses.TEMPLATES.values() for w in x.split()})
    return [(100 + i, " ".join(rng.choice([*vocab, "filler", "other"]) if rng.random() < 0.7 else rng.choice(list(licenses.TEMPLATES.values())) for _ in range(rng.randint(1, 120)))) for i in range(n)]


def test_equals_brute_force(spark):
    rows = TEXTS + random_texts()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, places int, labels string")
    found = licenses.scan(df).collect()
    assert len(found) == len(rows)
    want = sorted(((i, *brute(t)) for i, t in rows), key=str)
    got = sorted(((r["doc_id"], r["n_words"], sorted((p["word"], p["label"]) for p in r["places"]), sorted((b["from"], b["to"], b["label"], b["containment"]) for b in r["blocks"])) for r in found), key=str)
    assert got == want


def test_flat_rows(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.labels(licenses.scan(df)).collect()}
    assert tuple(rows[1])[1:] == (5, 1, 3, 3, "mit", "mit,mit-notice", 1.0)
    assert tuple(rows[2])[1:] == (0, 0, None, None, "", "", 0.0)
    assert (rows[4]["n_base"], rows[4]["first_word"], rows[4]["last_word"]) == (3, 0, 4)
    assert rows[5]["labels"] == "bsd-redistribution" and rows[5]["score"] == 1.0 and rows[7]["n_base"] == 0


def test_a_notice_needs_the_name_of_its_license(spark):
    """What a short notice shares with others doesn't make it theirs."""
    texts = ["released under the apache license", "licensed under cc by 4 0", "licensed under the eclipse license version 2 0", "released under the mit license", "licensed under CC BY-NC 4.0"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["labels"] for r in licenses.labels(licenses.scan(df)).collect()}
    assert [rows[i] for i in range(5)] == ["apache", "cc-by", "", "mit,mit-notice", "cc-by,cc-by-nc-notice"]


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op9_license_set_join(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, places, blocks = brute(texts[r["doc_id"]])
        base = {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(places), ",".join(sorted(base)))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["labels"] == ",".join(sorted(base | {b[2] for b in blocks})) and 0 <= r["score"] <= 1
