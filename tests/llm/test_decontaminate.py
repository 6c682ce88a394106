from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from panelyard.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, own = words(t), set(), set()
        for i, b in items:
            v = words(b)
            n = min(13, len(v))
            for s in range(len(v) - n + 1) if v else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[s:s + n]:
                        hit.update(range(p, p + n))
                        own |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), sorted(own), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.find_contamination(d, b, **kw).select("*", dc.is_contaminated(F.col("n_words"), F.col("n_hit")).alias("bad")).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["bad"]) for r in rows), key=str)


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards watch from a hill nearby and cheer"
ITEMS = [(1, ITEM), (2, "Short item"), (3, None), (4, "... !!"), (None, "nameless thing"), (2, "Short item"), (5, "über zwölf Éa")]
DOCS = [
    (1, "x " * 30 + ITEM.upper() + " y" * 5), (2, "short ITEM; short item? short-item"), (3, None), (4, ""), (5, "clean " * 400 + "short item"), (6, " ".join(ITEM.split()[:12])),
    (7, "nameless thing"), (8, "zwölf über zwölf Éa zwölf"), (8, "zwölf über zwölf Éa zwölf"), (None, ITEM), (9, "short item " * 3000), (10, "über zwölf éa"),
]


@pytest.mark.parametrize("most", [100_000, 3])
def test_equals_brute_force(spark, most):
    assert found(spark, DOCS, ITEMS, max_windows=most) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == []
    assert found(spark, DOCS, []) == brute(DOCS, [])


@pytest.mark.parametrize("most", [100_000, 3])
def test_removal_keeps_columns_and_clean_rows(spark, most):
    df = spark.createDataFrame([(*d, "own", 3) for d in DOCS], "doc_id long, text string, found string, n_words int")
    left = dc.remove_contaminated(df, spark.createDataFrame(ITEMS, "item_id long, text string"), max_windows=most)
    assert left.columns == df.columns
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[4]}
    assert sorted(map(str, (r["doc_id"] for r in left.collect()))) == sorted(str(d) for d, _ in DOCS if d not in bad)


def test_query_equals_its_sql(spark):

    from compare import compare, connect

    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    ok, message, _ = compare(spark, connect(sf), "op6", queries.op6_benchmark_decontamination, queries.ORACLES["op6_benchmark_decontamination"], sf)
    assert ok, message


def test_both_ways_keep_columns_of_any_name(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, passage, "m", "i"), (2, "quite another text", "m", "i"), (None, passage, "m", "i"), (None, None, "m", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __mark string, its_id string")
    items = spark.createDataFrame([(5, passage)], "item_id long, text string")
    for most in (100_000, 0):
        kept = dc.remove_contaminated(docs, items, max_windows=most)
        assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[1], rows[3]], key=str)
