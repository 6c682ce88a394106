"""License scans by an exact set-similarity join of text blocks with license templates.

Template tokens are put in the order of their frequency in the whole corpus, rarest first. A block contains a template
if it holds at least ``THRESHOLD`` of the template's distinct tokens and the words that name the license, so it must hold one of its first
|T| - needed + 1 tokens (prefix filter); a block with fewer words than needed can't (length filter); and at each match
the tokens after it in the order bound what can still come (positional filter). A block is every run of ``2 * n``
words, one each ``n`` words, n being the most words of a template, so that every passage up to n words is whole in one.
Phrases are templates whose tokens must all be there, in their order and side by side: the rarest word finds the place.

The index holds templates only, so a document is one row in one task and no document meets another.

Defined cases: null and empty texts have no words, no places and score 0; places may overlap; extra columns are
ignored; repeated rows get the same answer; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import LOWER, UPPER, id_and_text, map_arrow, word_array

THRESHOLD = 0.8
# fixed values: phrases with their labels, as the contract has them
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# fixed values: usual notices of licenses, with labels of this operator
TEMPLATES = {
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-header": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-notice": "released under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
}
#: words without which a notice isn't of its license, whatever else of it is there
NAMES = {
    "gpl-notice": "gnu", "gpl-header": "gnu", "apache-notice": "apache", "apache-header": "apache", "cc-by-nc-notice": "cc by nc",
    "cc-by-notice": "creative commons attribution", "mit-notice": "mit",
}
#: bytes.translate table: A-Z lower-cased, ASCII other than letters and digits blank
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_WORDS = _WORDS.translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


def frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How often each word of ``vocabulary`` occurs in all documents; counted before the exchange."""
    words = docs.select(F.explode(word_array(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary))
    return {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary


@dataclass
class Index:
    """Templates and phrases by the tokens that must be there."""

    counts: dict[str, int]
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    threshold: float = THRESHOLD
    names: dict[str, str] = field(default_factory=lambda: dict(NAMES))

    def __post_init__(self) -> None:
        rank = lambda w: (self.counts.get(w.decode(), 0), w)
        self.half = max([1, *(len(t.split()) for t in self.templates.values())])
        self.sets: dict[str, tuple[list[bytes], int]] = {}
        self.named = {label: set(self.names.get(label, "").encode().split()) for label in self.templates}
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        for label, text in self.templates.items():
            tokens = sorted(set(text.encode().split()), key=rank)
            needed = ceil(self.threshold * len(tokens) - 1e-9)
            self.sets[label] = (tokens, needed)
            for i, t in enumerate(tokens[:len(tokens) - needed + 1]):
                self.prefix.setdefault(t, []).append((label, i))
        self.anchors: dict[bytes, list[tuple[list[bytes], int, str]]] = {}
        for text, label in self.phrases.items():
            ws = text.encode().split()
            at = min(range(len(ws)), key=lambda i: rank(ws[i]))
            self.anchors.setdefault(ws[at], []).append((ws, at, label))
        self.found_by = self.prefix.keys() | self.anchors.keys()

    def _overlap(self, tokens: list[bytes], needed: int, block: set[bytes], at: int) -> int:
        """Tokens of a template in a block, the first of which is at ``at``; 0 once too few can come."""
        got = 0
        for i in range(at, len(tokens)):
            if got + len(tokens) - i < needed:
                return 0
            got += tokens[i] in block
        return got

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
        """Places (word, label) of phrases, and blocks (from, to, label, containment) that contain templates."""
        if self.found_by.isdisjoint(words):
            return [], []
        places, blocks, seen = [], [], {}
        for p, w in enumerate(words):
            if w not in self.found_by:
                continue
            for ws, at, label in self.anchors.get(w, ()):
                if p >= at and words[p - at:p - at + len(ws)] == ws:
                    places.append((p - at, label))
            for label, i in self.prefix.get(w, ()):
                for b in {max(0, p // self.half - 1), p // self.half}:
                    first = seen.get((b, label))
                    seen[b, label] = i if first is None else min(first, i)
        sets: dict[int, set[bytes]] = {}
        for (b, label), first in sorted(seen.items()):
            tokens, needed = self.sets[label]
            start, end = b * self.half, min(len(words), (b + 2) * self.half)
            if end - start < needed:
                continue
            block = sets.get(b) or sets.setdefault(b, set(words[start:end]))
            got = self._overlap(tokens, needed, block, first)
            if got >= needed and self.named[label] <= block:
                blocks.append((start, end, label, got / len(tokens)))
        return sorted(set(places)), blocks


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (word, label), blocks (from, to, label, containment), a row per row."""
    docs = id_and_text(docs, id_col, text_col)
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    vocabulary = sorted({w for t in [*templates.values(), *phrases] for w in t.split()})
    counts = frequencies(docs, vocabulary)
    place, block = pa.struct([("word", pa.int64()), ("label", pa.string())]), pa.struct([("from", pa.int64()), ("to", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
    kinds = "cast(array() as array<struct<word:bigint,label:string>>) places", "cast(array() as array<struct<`from`:bigint,`to`:bigint,label:string,containment:double>>) blocks"
    schema = docs.selectExpr("doc_id", "0L as n_words", *kinds).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts, templates, phrases, threshold)
        for batch in batches:
            n, places, blocks = [], [], []
            for t in batch.column("text").cast(pa.binary() if pa.types.is_string(batch.schema.field("text").type) else pa.large_binary()):
                ws = words_of(t.as_py())
                p, b = index.scan(ws)
                n.append(len(ws))
                places.append([{"word": w, "label": x} for w, x in p])
                blocks.append([{"from": s, "to": e, "label": x, "containment": c} for s, e, x, c in b])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block))], ["doc_id", "n_words", "places", "blocks"])

    return map_arrow(docs, run, schema)


def labels(scanned: DataFrame) -> DataFrame:
    """One flat row per document: n_base, first_word, last_word, base_labels, labels, score (the best containment; 1 with a phrase)."""
    joined = lambda e: F.array_join(F.array_sort(F.array_distinct(e)), ",")
    base, own = F.expr("transform(places, p -> p.label)"), F.expr("transform(blocks, b -> b.label)")
    starts = F.expr("transform(places, p -> p.word)")
    best = F.coalesce(F.array_max(F.expr("transform(blocks, b -> b.containment)")), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
