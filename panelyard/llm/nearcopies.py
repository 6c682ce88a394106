"""Near copies by exact Jaccard similarity of five-word shingles; one row of each group stays.

Candidates come from SimHash, by the operator of ``simhash``: the texts of a component of fingerprints within three bits
are a band. Few of the pairs of similarity 0.8 are as near as that, so MinHash bands add candidates to these. Everything
after it is exact, for bands of any size and of either kind:

- Texts are named by a key (hash of their words); copies are one text from there on.
- In each band every text is compared with the smallest and the largest key. Bands of up to three are whole then; in
  larger ones most near copies are one component already.
- A larger band whose texts lie in several components is open. Pairs inside a component can't matter any more, so in each
  open band the texts outside its commonest component meet all its texts. Bands with the same commonest component do this
  together, in blocks of bounded shingles (a block of outsiders by a block of all), so that no task holds a whole group
  and just the edges that join components leave it.

Only keys, sizes and band numbers move for all texts. Shingles are made of texts that share a band; texts move only if
what is to go doesn't fit a broadcast.

Defined cases: texts without words (null, empty, blank) are one group; a text under five words is one shingle; of equal
rows one stays; of a group the row of the smallest id stays, a null id counts as the largest; an id on several texts
names rows by id and text; extra columns stay, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.groups import BROADCAST_ROWS
from panelyard.functions.storage import materialize, release, written
from panelyard.llm.common import ASCII_LOWER, map_arrow
from panelyard.llm.simhash import components, fingerprint_of, print_roots

#: words of a shingle, bands, and minima of a band: texts of similarity 0.8 share no band once in 37,000 pairs
SHINGLE, BANDS, ROWS = 5, 20, 4
#: shingles of a block of texts that meet in one task
BLOCK = 500_000
_FACTORS = np.random.default_rng(42).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ASCII_LOWER).split()


def key_of(words: list[bytes]) -> int:
    """Signed 64-bit hash of a text's words: the same for texts that differ in A-Z case and white space only."""
    n = xxhash.xxh64_intdigest(b" ".join(words), 7)
    return n - (n >> 63 << 64)


def shingle_hashes(words: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles of a whole text; a shorter text is one shingle, one without words has none."""
    if not words:
        return np.zeros(0, np.uint64)
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles), np.uint64))


def bands_of(hashes: np.ndarray) -> list[int]:
    """A signed key for each of BANDS bands of ROWS minima."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, (_FACTORS[:, None] * hashes[i:i + 4096]).min(1))
    raw = low.tobytes()
    return np.array([xxhash.xxh64_intdigest(raw[8 * ROWS * b:8 * ROWS * (b + 1)], b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def _texts(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    for t in batch.column("text").cast(pa.large_binary()):
        yield words_of(t.as_py())


def _named(docs: DataFrame) -> DataFrame:
    """Each row as a struct, whatever its columns are called, with its id and a hash of its text as it stands."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("raw"))


def sketches(named: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, raw, key, size (shingles), fp (SimHash as in ``simhash``, a signed long) and MinHash bands, a row per row."""
    rows = named.select("doc_id", "raw", "text")
    schema = rows.selectExpr("doc_id", "raw", "0L as key", "0 as size", "0L as fp", "cast(array() as array<bigint>) bands").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, bands = [], [], [], []
            for words in _texts(batch):
                hashes = shingle_hashes(words, width)
                keys.append(key_of(words))
                sizes.append(len(hashes))
                prints.append(fingerprint_of(words))
                bands.append(bands_of(hashes) if len(hashes) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("raw"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "raw", "key", "size", "fp", "bands"])

    return map_arrow(rows, run, schema)


def _bring(named: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows of ``named`` with (left_semi) or without (left_anti) an id and text hash in ``chosen``, a written table.

    ``chosen`` is counted and broadcast up to BROADCAST_ROWS rows; beyond, both sides are dealt by id and hash.
    """
    side = chosen.select(F.col("doc_id").alias("its_id"), F.col("raw").alias("its_raw"))
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    return named.join(side, (named["raw"] == side["its_raw"]) & named["doc_id"].eqNullSafe(side["its_id"]), how)


def shingle_table(named: DataFrame, chosen: DataFrame, width: int = SHINGLE) -> DataFrame:
    """key and shingles of the texts ``chosen`` (doc_id, raw, rows), once each."""
    texts = _bring(named, chosen, "left_semi").select("doc_id", "raw", "text")
    if chosen.where("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 100):
                words = list(_texts(whole.slice(i, 100)))
                hashes = [shingle_hashes(w, width) for w in words]
                flat = pa.array(np.concatenate([np.zeros(0, np.uint64), *hashes]).view(np.int64))
                shingles = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in words], pa.int64()), shingles], ["key", "shingles"])

    return map_arrow(texts, run, "key long, shingles array<long>")


def _alike(common, total, least: float):
    """Whether so many common shingles of two texts with ``total`` ones make a Jaccard similarity of ``least``."""
    return common >= least * (total - common) - 1e-9


def verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingles are similar."""
    of = lambda k, s: held.select(F.col("key").alias(k), F.col("shingles").alias(s))
    both = pairs.join(of("a", "left"), "a").join(of("b", "right"), "b")
    common = both.select("a", "b", F.size(F.array_intersect("left", "right")).alias("n"), (F.size("left") + F.size("right")).alias("total"))
    return common.where(_alike(F.col("n"), F.col("total"), F.lit(least))).select("a", "b")


def block_edges(keys: np.ndarray, comps: np.ndarray, outside: np.ndarray, shingles: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Edges that join components: similar pairs of a text ``outside`` with another one, none between joined ones."""
    sizes = np.array([len(s) for s in shingles])
    flat = np.concatenate(shingles)
    number = np.unique(flat, return_inverse=True)[1]
    order = number.argsort(kind="stable")
    holder = np.repeat(np.arange(len(sizes)), sizes)[order]
    start = np.searchsorted(number[order], np.arange(number.max(initial=-1) + 2))
    at = np.concatenate([[0], np.cumsum(sizes)])
    label = np.unique(comps, return_inverse=True)[1]
    left, right = [], []
    for i in np.flatnonzero(outside):
        if (label == label[0]).all():
            break
        own = number[at[i]:at[i + 1]]
        length = start[own + 1] - start[own]
        first = np.repeat(start[own] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        common = np.bincount(holder[first + np.arange(len(first))], minlength=len(sizes))
        for j in np.flatnonzero(_alike(common, sizes + sizes[i], least) & (label != label[i])):
            if label[j] != label[i]:
                left.append(int(keys[i]))
                right.append(int(keys[j]))
                label[label == label[j]] = label[i]
    return left, right


def open_edges(met: DataFrame, roots: DataFrame, held: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """Edges between components that meet in bands of more than three texts."""
    large = met.where("n > 3").select("band", "key", "size")
    member = materialize(large.join(roots, large["key"] == roots["node"], "left").select("band", "key", "size", F.coalesce("root", "key").alias("comp")))
    counted = member.groupBy("band", "comp").agg(F.count("*").alias("n"))
    major = counted.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1").select("band", F.col("top.comp").alias("major"))
    part = materialize(member.join(major, "band").select("major", "key", "size", "comp").distinct())
    outside = F.col("comp") != F.col("major")
    blocks = part.groupBy("major").agg(F.sum(F.when(outside, F.col("size")).otherwise(0)).alias("few"), F.sum("size").alias("all"))
    blocks = materialize(blocks.select("major", F.ceil(F.col("few") / block).cast("int").alias("of_few"), F.ceil(F.col("all") / block).cast("int").alias("of_all")))
    dealt = part.join(blocks, "major")
    place = lambda of: F.pmod(F.xxhash64("key"), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    met_all = dealt.select("major", each("of_few").alias("i"), place(F.col("of_all")).alias("j"), "key", "comp", F.lit(False).alias("outside"))
    met_few = dealt.where(outside).select("major", place(F.col("of_few")).alias("i"), each("of_all").alias("j"), "key", "comp", F.lit(True).alias("outside"))
    rows = met_all.unionByName(met_few).join(held, "key")

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("shingles").combine_chunks()
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        shingles = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        column = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        a, b = block_edges(column("key"), column("comp"), column("outside"), shingles, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("major", "i", "j").applyInArrow(run, "a long, b long")


def simhash_bands(sketched: DataFrame) -> DataFrame:
    """key, size and band of the texts with words: those of a component of fingerprints within three bits share a band."""
    texts = sketched.where("size > 0").select("key", "size", "fp")
    roots = print_roots(materialize(texts.select("fp").distinct()))
    return texts.join(roots, texts["fp"] == roots["node"], "left").select("key", "size", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("band"))


def similar(sketched: DataFrame, named: DataFrame, width: int = SHINGLE, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of keys that connect just what texts of similarity ``least`` or more that share a band of SimHash or MinHash connect."""
    members = materialize(sketched.select("key", "size", F.explode("bands").alias("band")).unionByName(simhash_bands(sketched)).distinct())
    ends = members.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("key", "size")).alias("low"), F.max(F.struct("key", "size")).alias("high")).where("n > 1")
    met = materialize(members.join(ends, "band"))
    pair = lambda a, b, x, y: met.where(F.col(a) < F.col(b)).where(_alike(F.least(x, y), F.col(x) + F.col(y), F.lit(least))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = materialize(pair("low.key", "key", "low.size", "size").unionByName(pair("key", "high.key", "size", "high.size")).distinct())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "raw")).alias("first")
    of_key = sketched.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(first).select("first.doc_id", "first.raw")
    rows = sketched.groupBy("doc_id", "raw").agg(F.count("*").alias("rows"))
    chosen = materialize(of_key.join(rows.withColumnsRenamed({"doc_id": "its_id", "raw": "its_raw"}), (F.col("raw") == F.col("its_raw")) & F.col("doc_id").eqNullSafe(F.col("its_id"))).select("doc_id", "raw", "rows"))
    held = materialize(shingle_table(named, chosen, width))
    edges = materialize(verified(pairs, held, least))
    more = open_edges(met, components(edges), held, least, block)
    return edges.unionByName(more)


def keep_one_of_each(docs: DataFrame, width: int = SHINGLE, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """Documents of ``docs``, all columns, one row of each component of texts similar by shingles: that of its smallest id.

    Tables that were written on the way are deleted before it returns; what remains are the ids and hashes that go.
    """
    spark = docs.sparkSession
    before = written(spark)
    named = _named(docs)
    sketched = materialize(sketches(named, width))
    roots = materialize(components(similar(sketched, named, width, least, block)))
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "raw")
    texts = sketched.groupBy("key").agg(F.min(first).alias("first"))
    rooted = texts.join(roots, texts["key"] == roots["node"], "left").groupBy(F.coalesce("root", "key")).agg(F.min("first").alias("first"))
    heads = materialize(rooted.select(F.col("first.doc_id").alias("head_id"), F.col("first.raw").alias("head_raw")))
    rows = sketched.groupBy("doc_id", "raw").agg(F.count("*").alias("rows"))
    judged = rows.join(heads, (F.col("raw") == F.col("head_raw")) & F.col("doc_id").eqNullSafe(F.col("head_id")), "left")
    # rows that go, and rows of which one stays
    out = materialize(judged.where("head_raw is null or rows > 1").select("doc_id", "raw", F.col("head_raw").isNotNull().alias("repeated")))
    release(spark, before, keep=[out])
    kept = _bring(named, out, "left_anti").select("row.*")
    if out.where("repeated").limit(1).count():
        one = _bring(named, out.where("repeated"), "left_semi").dropDuplicates(["doc_id", "raw"]).select("row.*")
        kept = kept.unionByName(one)
    return kept
