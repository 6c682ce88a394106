"""Benchmark decontamination: hash set of normalised benchmark windows against every window of every document.

An item gives all its windows of 13 words, or itself if shorter. Each window has one anchor, the word of it that is
rarest in the benchmark; a document's words are tested against the hash set of anchors, and around each anchor the
exact window is looked up in the hash set of windows. A document is one row throughout: no exchange moves texts or
words. The sets are literals of the plan, which is a broadcast; their size is counted first, and beyond ``max_windows``
the windows of documents are joined with those of the benchmark by their text instead.

Defined cases: null and empty texts have no words and are clean; an item without words has no window; an item with a
null id marks words but isn't counted; repeated items or documents change nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize
from panelyard.llm.common import id_and_text, word_array

WINDOW = 13


def _windows(words: Column, size: int = WINDOW) -> Column:
    """Texts of all windows of an item."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.concat_ws(" ", F.slice(words, s, F.lit(size)))))


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window) rows."""
    words = items.select(items[id_col].cast("string").alias("item_id"), word_array(items[text_col]).alias("w"))
    return words.select("item_id", F.explode(_windows(F.col("w"), size)).alias("window")).distinct()


def _anchors(windows: list[str]) -> tuple[list[str], list[tuple[int, int]]]:
    """Rarest word of each window, the longer of equally rare ones; and the (length, place of an anchor) pairs that occur."""
    split = [w.split(" ") for w in windows]
    seen = Counter(w for ws in split for w in ws)
    anchors = {min(ws, key=lambda w: (seen[w], -len(w), w)) for ws in split}
    return sorted(anchors), sorted({(len(ws), i) for ws in split for i, w in enumerate(ws) if w in anchors})


def _scan(words: Column, windows: list[str]) -> Column:
    """struct(n_words, hits): hits are the places and lengths of all occurring windows, with their hashes."""
    anchors, pairs = _anchors(windows)
    known = F.array(*[F.struct(F.lit(n).alias("len"), F.lit(o).alias("off")) for n, o in pairs])

    def around(w: Column, i: Column) -> Column:
        def text(p: Column) -> Column:
            return F.concat_ws(" ", F.slice(w, i - p["off"] + 1, p["len"]))

        fits = F.filter(known, lambda p: (i >= p["off"]) & (i - p["off"] + p["len"] <= F.size(w)) & text(p).isin(windows))
        return F.transform(fits, lambda p: F.struct((i - p["off"]).alias("at"), p["len"].alias("len"), F.xxhash64(text(p)).alias("hash")))

    def scan(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        near = F.filter(places, lambda i: F.get(w, i).isin(anchors))
        return F.struct(F.size(w).alias("n_words"), F.array_distinct(F.flatten(F.transform(near, lambda i: around(w, i)))).alias("hits"))

    return F.element_at(F.transform(F.array(words), scan), 1)  # a lambda's argument is computed once


def _scan_by_join(docs: DataFrame, windows: DataFrame, size: int) -> DataFrame:
    """The same rows for benchmarks that are too large for a plan: windows of documents meet those of items in a join."""
    lengths = [r[0] for r in windows.select(F.size(F.split("window", " ")).alias("n")).distinct().orderBy("n").collect()]  # at most `size` rows
    base = docs.select("doc_id", "mark", word_array(F.col("text")).alias("w"))
    cuts = [
        base.where(F.size("w") >= n).select("doc_id", "mark", F.explode(F.expr(f"transform(sequence(1, size(w) - {n} + 1), s -> named_struct('at', s - 1, 'len', {n}, 'window', concat_ws(' ', slice(w, s, {n}))))")).alias("c"))
        for n in lengths
    ]
    every = cuts[0]
    for c in cuts[1:]:
        every = every.unionByName(c)
    hit = every.select("doc_id", "mark", "c.*").join(windows.select("window").distinct(), "window", "left_semi")
    hits = hit.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("at", "len", F.xxhash64("window").alias("hash"))).alias("hits"))
    counted = base.select("doc_id", "mark", F.size("w").alias("n_words"))
    joined = counted.alias("d").join(hits.alias("h"), F.expr("d.doc_id <=> h.doc_id and d.mark = h.mark"), "left")
    return joined.select("d.doc_id", "d.mark", F.struct("d.n_words", F.coalesce("h.hits", F.array().cast("array<struct<at:int,len:int,hash:bigint>>")).alias("hits")).alias("found"))


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_windows: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text), n_words, n_hit, items (sorted ids), spans (hit word places), a row per document."""
    docs = id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    windows = materialize(benchmark_windows(items, size=size))
    n = windows.count()
    if n == 0:
        found = docs.select("doc_id", "mark", F.struct(F.size(word_array(F.col("text"))).alias("n_words"), F.array().cast("array<struct<at:int,len:int,hash:bigint>>").alias("hits")).alias("found"))
    elif n <= max_windows:
        texts = [r[0] for r in windows.select("window").distinct().orderBy("window").collect()]  # at most max_windows
        found = docs.select("doc_id", "mark", _scan(word_array(F.col("text")), texts).alias("found"))
    else:
        found = _scan_by_join(docs, windows, size)
    found = materialize(found)  # slim: ids, counts and hits; read by both branches below
    hits = found.where(F.size("found.hits") > 0).select("doc_id", "mark", F.explode(F.array_distinct(F.expr("transform(found.hits, h -> h.hash)"))).alias("hash"))
    known = windows.select(F.xxhash64("window").alias("hash"), "item_id")
    named = hits.join(known, "hash").groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    joined = found.alias("f").join(named.alias("n"), F.expr("f.doc_id <=> n.doc_id and f.mark = n.mark"), "left")
    spans = F.array_sort(F.array_distinct(F.flatten(F.expr("transform(found.hits, h -> sequence(h.at, h.at + h.len - 1))"))))
    return joined.select(F.col("f.doc_id"), F.col("f.mark"), F.col("found.n_words"), F.coalesce("n.items", F.array().cast("array<string>")).alias("items"), spans.alias("spans")).withColumn("n_hit", F.size("spans"))


def is_contaminated(n_words: Column, n_hit: Column, share: int = 20) -> Column:
    """At least one word is hit, and a twentieth of all words."""
    return (n_hit > 0) & (n_hit * share >= n_words)


def remove_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, max_windows: int = 100_000) -> DataFrame:
    """Documents of ``docs``, all columns, that aren't contaminated; the scan is a filter, so texts stay where they are."""
    windows = materialize(benchmark_windows(items, size=size))
    n = windows.count()
    if n == 0:
        return docs
    if n <= max_windows:
        texts = [r[0] for r in windows.select("window").distinct().orderBy("window").collect()]  # at most max_windows

        def clean(found: Column) -> Column:
            places = F.flatten(F.transform(found["hits"], lambda h: F.sequence(h["at"], h["at"] + h["len"] - 1)))
            return ~is_contaminated(found["n_words"], F.size(F.array_distinct(places)))

        return docs.where(F.element_at(F.transform(F.array(_scan(word_array(docs["text"]), texts)), clean), 1))
    found = find_contamination(docs, items, size, max_windows)
    bad = found.where(is_contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("doc_id").alias("its_id"), F.col("mark").alias("its_mark")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("own_id"), F.xxhash64(docs["text"]).alias("own_mark"))
    return rows.join(bad, F.expr("own_id <=> its_id and own_mark = its_mark"), "left_anti").select("row.*")
