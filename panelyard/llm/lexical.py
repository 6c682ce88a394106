"""Ranked lexical search with bag deduplication.

A document matters to the items only by how often it holds each of their words and by its length term ``m``, so it is cut
down to its bag: the (term, tf) pairs of the items' vocabulary. Bags with equal hash, ``m`` and bytes are one class. A
class is scored once, against all items at a time, and gives its score to its members; as all of them tie, its ``k``
smallest ids are all that any item's first ``k`` can need, so a class of any size travels as ``k`` ids, cut before the
exchange.

Items come in blocks of about ``BLOCK_WORDS`` words and ``BLOCK_ITEMS`` items (counted first), so what a task holds of them is bounded however many
there are; every block is ranked against all documents. Each scoring task keeps the first ``k`` of every item and hands
on just these.

Defined cases: a null or empty text has no terms and is never found, but null ids are (after all others among equal
scores); repeated rows of documents are documents of their own; rows of items that repeat both id and text are one item;
an item without terms, or whose terms no document holds, gives no rows; extra columns are ignored; an empty table of
either kind gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelyard.functions.storage import materialize
from panelyard.llm.common import LOWER, UPPER, id_and_text, map_arrow, word_array

#: words and items that one block holds, and classes scored at a time
BLOCK_WORDS, BLOCK_ITEMS, CLASSES = 200_000, 2_000, 250
#: products of a (class, term) entry with an item that are summed at once
_AT_ONCE = 1 << 21
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
_PAIR = np.dtype("<i4")


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters and digits and of all other characters, A-Z lower-cased."""
    return (text or b"").translate(_BLANK).split()


class Queries:
    """Items of a block as postings: for each term its id, and the items that hold it with their counts."""

    def __init__(self, rows: list[tuple[int | None, list[bytes]]]) -> None:
        self.ids = [i for i, _ in rows]
        self.terms = sorted({w for _, ws in rows for w in ws})
        self.number = {w: t for t, w in enumerate(self.terms)}
        found = sorted((self.number[w], q, n) for q, (_, ws) in enumerate(rows) for w, n in Counter(ws).items())
        term, self.item, self.count = np.array(found, np.int64).reshape(-1, 3).T
        self.start = np.searchsorted(term, np.arange(len(self.terms) + 1))

    def weigh(self, documents: int, df: dict[int, int]) -> None:
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(self.terms))], np.int64)
        most = np.bincount(self.item, self.count * np.repeat(self.weight, np.diff(self.start)) * 1e6, len(self.ids))
        self.exact_in_doubles = not len(most) or most.max() < 2**52

    def scores(self, bags: list[np.ndarray], m: np.ndarray) -> np.ndarray:
        """Score of each bag (rows) for each item (columns); integers, however large the sums are."""
        sizes = np.array([len(b) for b in bags], np.int64)
        pairs = np.concatenate(bags).astype(np.int64) if bags else np.zeros((0, 2), np.int64)
        row, term, tf = np.repeat(np.arange(len(bags)), sizes), pairs[:, 0], pairs[:, 1]
        value = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
        reach = self.start[term + 1] - self.start[term]
        at = np.concatenate([[0], np.cumsum(reach)])
        out = np.zeros(len(bags) * len(self.ids), np.int64)
        low = 0
        while low < len(term):
            high = max(low + 1, int(np.searchsorted(at, at[low] + _AT_ONCE, "right")) - 1)
            n = reach[low:high]
            where = np.arange(at[high] - at[low]) + np.repeat(self.start[term[low:high]] - (at[low:high] - at[low]), n)
            cell = np.repeat(row[low:high] * len(self.ids), n) + self.item[where]
            part = np.repeat(value[low:high], n) * self.count[where]
            if self.exact_in_doubles:
                out += np.bincount(cell, part, len(out)).astype(np.int64)
            else:
                np.add.at(out, cell, part)
            low = high
        return out.reshape(len(bags), len(self.ids))


class Best:
    """The first k of every item so far: highest score, then smallest id, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.kept, self.least = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, scores: np.ndarray, members: list[list[int | None]]) -> None:
        least = self.least
        if len(scores) > self.k:  # k classes hold k members at least
            least = np.maximum(least, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        touched = set()
        for c, q in zip(*np.nonzero(scores >= least), strict=True):
            self.kept[q] += [(-int(scores[c, q]), d is None, d or 0) for d in members[c]]
            touched.add(q)
        for q in touched:
            self.kept[q] = sorted(self.kept[q])[:self.k]
            if len(self.kept[q]) == self.k:
                self.least[q] = -self.kept[q][-1][0]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Queries]:
    """Items in blocks of bounded words and numbers; one item always is whole in one block."""
    items = id_and_text(items, id_col, text_col).distinct().select("doc_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    there = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words")).first()
    blocks = max(-(-there["words"] // BLOCK_WORDS), -(-there["n"] // BLOCK_ITEMS))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("doc_id", "w"), F.lit(blocks)) == b).collect()
        if rows:
            yield Queries([(r["doc_id"], [w.encode() for w in r["w"]]) for r in rows])


def bags(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text) and the bag: (term, tf) pairs as little-endian 32-bit integers, by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, packed = [], []
            for t in batch.column("text").cast(pa.large_binary()):
                ws = terms_of(t.as_py())
                held = Counter(map(number.get, ws))
                held.pop(None, None)
                n.append(len(ws))
                packed.append(np.array(sorted(held.items()), _PAIR).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "bag"])

    return map_arrow(docs, run, "doc_id long, n long, bag binary")


def _pairs(bag: bytes) -> np.ndarray:
    return np.frombuffer(bag, _PAIR).reshape(-1, 2)


def document_frequencies(bagged: DataFrame, terms: int) -> dict[int, int]:
    """Documents that hold each term; a task sends one row a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for b in batch.column("bag"):
                total[_pairs(b.as_py())[:, 0]] += 1
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["term", "df"])

    counted = map_arrow(bagged.select("bag"), run, "term int, df long")
    return {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most a block's terms


def classes(bagged: DataFrame, documents: int, length: int, k: int) -> DataFrame:
    """bag, m and the k smallest ids of each class: equal hash, equal m, equal bytes."""
    m = F.expr(f"25 + cast(cast(75 * n as decimal(19, 0)) * cast({documents}L as decimal(19, 0)) div {max(1, length)}L as bigint)")
    of = bagged.where(F.length("bag") > 0).select("doc_id", "bag", m.alias("m"), F.xxhash64("bag").alias("h"))
    order = F.row_number().over(Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last()))
    first = of.withColumn("place", order).where(F.col("place") <= k)
    return first.groupBy("h", "m", "bag").agg(F.collect_list(F.struct("doc_id")).alias("members"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    docs = id_and_text(docs, id_col, text_col)
    ranked = [_search_block(docs, block, k) for block in item_blocks(items, item_id, item_text)]
    return reduce(DataFrame.unionAll, ranked) if ranked else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search_block(docs: DataFrame, block: Queries, k: int) -> DataFrame:
    bagged = materialize(bags(docs, block.number))
    total = bagged.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    block.weigh(total["documents"], document_frequencies(bagged, len(block.terms)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.ids), k)
        for batch in (whole.slice(i, CLASSES) for whole in batches for i in range(0, whole.num_rows, CLASSES)):
            rows = batch.column("members").to_pylist()
            best.add(block.scores([_pairs(b.as_py()) for b in batch.column("bag")], batch.column("m").to_numpy()), [[x["doc_id"] for x in r] for r in rows])
        kept = [(q, None if missing else d, -s) for q, found in enumerate(best.kept) for s, missing, d in found]
        q, d, s = zip(*kept, strict=True) if kept else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(d, pa.int64()), pa.array(s, pa.int64())], ["q", "doc_id", "score"])

    scored = map_arrow(classes(bagged, total["documents"], total["length"], k).select("bag", "m", "members"), run, "q int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ids = docs.sparkSession.createDataFrame(list(enumerate(block.ids)), "q int, item_id long")
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(ids), "q").select("item_id", "rank", "doc_id", "score")
