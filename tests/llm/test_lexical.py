"""Search against a plain ranking of all documents for every item."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from panelyard.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(t or "")]


def brute(docs, items, k=10):
    parsed = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(bool(w) for _, w in parsed), sum(len(w) for _, w in parsed)
    df = {}
    for _, w in parsed:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in {tuple(i) for i in items}:
        scored = []
        for d, w in parsed:
            s = 0
            if w:
                m = 100 - 75 + (75 * len(w) * n_docs) // length
                for t in terms(text):
                    if tf := w.count(t):
                        s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, k=10):
    d = spark.createDataFrame([(*r, 1, "x", 2.0) for r in docs], "doc_id long, text string, n int, bag string, score double")
    i = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in lexical.search(d, i, k).collect()), key=str)


def random_case(seed, n=300):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["É", "naïve", "Zé"]
    text = lambda a, b: " ".join(rng.choice(vocab[: rng.randint(3, len(vocab))]) for _ in range(rng.randint(a, b)))
    docs = [(i, text(0, 30)) for i in range(n)]
    docs += [(rng.randint(0, 5000), rng.choice(docs)[1]) for _ in range(n)]  # copies, and ids that repeat
    docs += [(7000 + i, "w1 W2 w3.w1") for i in range(60)]  # one class of many members
    return docs, [(i, text(0, 12)) for i in range(25)]


ODD = [(1, None), (2, ""), (None, "alpha beta"), (3, "Alpha, BETA"), (3, "Alpha, BETA"), (4, "alpha " * 30_000), (5, "beta " * 30_000 + "gamma"), (6, "... \n"), (None, "alpha beta"), (0, "ALPHA_beta")]


@pytest.mark.parametrize("case", [random_case(1), random_case(2), (ODD, [(1, "alpha beta"), (1, "alpha beta"), (2, None), (3, "nowhere"), (None, "gamma Gamma beta"), (4, ""), (1, "gamma")])])
def test_equals_brute_force(spark, case):
    docs, items = case
    want = brute(docs, items)
    assert found(spark, docs, items) == want and want


def test_many_blocks(spark, monkeypatch):
    docs, items = random_case(3, 100)
    monkeypatch.setattr(lexical, "BLOCK_WORDS", 20)
    monkeypatch.setattr(lexical, "_AT_ONCE", 50)
    monkeypatch.setattr(lexical, "CLASSES", 7)
    assert found(spark, docs, items, 3) == brute(docs, items, 3)


def test_classes_hold_k_members_at_most(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(500)] + [(1000, "b a"), (1001, "a b zz"), (None, "a b")], "doc_id long, text string")
    bagged = lexical.bags(docs, {b"a": 0, b"b": 1})
    rows = {r["m"]: [x["doc_id"] for x in r["members"]] for r in lexical.classes(bagged, 503, 1007, 4).collect()}
    assert [sorted(v) for _, v in sorted(rows.items())] == [[0, 1, 2, 3], [1001]]


def test_sums_beyond_exact_doubles():
    block = lexical.Queries([(1, [b"a"] * 9 + [b"b"])])
    block.weigh(10, {})
    assert block.exact_in_doubles
    bags, m = [np.array([[0, 3], [1, 1]], "<i4")], np.array([50])
    first = block.scores(bags, m)
    block.exact_in_doubles = False
    assert (first == block.scores(bags, m)).all()


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, None)])])
def test_empty_tables(spark, docs, items):
    assert found(spark, docs, items) == []


def test_query(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    read = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"{sf}/{n}.parquet").select(*c).collect()]
    got = sorted((tuple(r) for r in queries.op11_bag_search(spark, sf).collect()), key=str)
    assert got == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))
