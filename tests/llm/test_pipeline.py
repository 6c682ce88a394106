"""The pipeline against a plain version of its rules, stage by stage."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_decontaminate import brute
from test_nearcopies import plain_similar

import corpus_pipeline as cp
from panelyard.functions.storage import materialize
from panelyard.llm import language, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES[:-1]:
        out.append(materialize(stage(spark, out[-1], SF)))
    return [*out, cp.STAGES[-1][1](spark, out[-1], SF)]


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_toxicity_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = toxicity.score(stages[0], labels)
    assert set(texts(stages[1])) == {r["doc_id"] for r in scored.where(F.col("score") < toxicity.THRESHOLD).collect()}


def test_language_stage(stages):
    """The parse of each text by itself decides: its best language, and whether its phrases are as few as usual there."""
    samples, left = language.labelled_texts(stages[1])
    model = language.Model(samples)
    model.calibrate(left)
    before, kept = texts(stages[1]), set()
    for i, t in before.items():
        n = language.normalise(t)
        if n:
            found, blocks = model.phrases([n])
            best = int((found[0] * model.cost).argmin())
            if found[0, best] - blocks[0] <= language.LIMIT * model.usual.get(model.languages[best], 1.0) * len(n) + language.ALLOWANCE:
                kept.add(i)
    assert set(texts(stages[2])) == kept and len(kept) > 0.98 * len(before)


def test_near_dedup_stage(stages):
    """One document stays, that of the smallest id, of each component of texts with a Jaccard similarity of 0.8 or more."""
    assert set(texts(stages[3])) == set(plain_similar(texts(stages[2])).values())


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    held = {w for _, t in items for w in (t or "").lower().split()}
    before = texts(stages[3])
    near = [(i, t) for i, t in before.items() if sum(w in held for w in (t or "").lower().split()) >= 5]
    bad = {r[0] for r in brute(near[:150], items) if r[4]}
    after = set(texts(stages[4]))
    assert {i for i, _ in near[:150]} - after == bad and set(before) >= after


def test_last_stage(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before = texts(stages[4])
    rows = stages[5].collect()
    assert {r["doc_id"] for r in rows} == set(before)
    for r in rows:
        ids = library.encode(before[r["doc_id"]] or "", add_eos=True)
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_and_odd_tables(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "en", None, None), (None, "some words of text", None, "s", 3), (None, "some words of text", None, "s", 3), (2, "", "en", "s", 0), (3, "some words of text here", "en", "s", 1), (3, "some words of text here", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["3", "None"]
