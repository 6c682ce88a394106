"""A training corpus from documents: toxic texts, texts without a language, near copies and benchmark passages go, the rest becomes ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents. Toxicity, language and decontamination decide row by row and exchange no text. The near-dedup
stage searches by SimHash within three bits and, as few pairs of similarity 0.8 are as near as that, by MinHash bands as
well; it decides by exact Jaccard similarity of five-word shingles and moves texts only where what is to go doesn't fit a
broadcast. ``run`` deletes what a
stage wrote for itself once the stage's result is written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from panelyard.functions.storage import materialize, release, written
from panelyard.llm import decontaminate, language, nearcopies, pieces, toxicity
from panelyard.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves."""
    encoded = pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(encoded, keep=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_identified),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

#: models and graph components have no SQL; tests hold the pipeline against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, docs = written(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, before, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
