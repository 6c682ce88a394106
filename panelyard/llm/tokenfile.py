"""Token ids in raw files, with a minimal perfect hash index for keyed access.

Texts are dealt by ranges of ids (rows of one id by their text's hash and place), each task encodes its range in
ascending order of id and writes one payload file of unsigned little-endian ids (16 bits if the vocabulary allows)
without separators. The index maps (id, occurrence) to
file, offset and length. It is cut into parts by a hash of the key; each part has a minimal perfect hash of levels of
bit sets (a key that shares its place with another goes to the next level), whose rank gives the slot of its entry,
and the entry keeps a fingerprint that tells foreign keys. A look-up costs a bounded number of probes.

Defined cases: a null or empty text has the end id only; null ids come first; a repeated id has one entry for each of
its rows, numbered in the order of the text's hash, also where they are many and fill several files; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import io
import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize
from panelyard.llm import files
from panelyard.llm.common import held, id_and_text, map_arrow, scratch_path, ship

#: chunks and pre-tokens that a task remembers
REMEMBER = 800_000
_CHUNK = re.compile(r"[^ \t\n\r\f\v]+")
KEYS_PER_PART = 100_000
#: payload that one task reads back
READ_BYTES = 32 << 20

# fixed values: the normaliser and the pre-tokenizer for which texts may be cut at ASCII white space and simple chunks taken apart
_WORDS_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: words that normalisation only lower-cases, and marks that pre-tokenisation keeps together behind them
_WORD = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_MARKS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else the next from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def cuts_at_white_space(tokenizer: str) -> bool:
    """Whether a tokenizer (as JSON) drops white space, never looks across it and lower-cases words: read from its file."""
    t = json.loads(tokenizer)
    steps = (t["pre_tokenizer"] or {}).get("pretokenizers") or [{}, {}]
    split, letters = steps[0], steps[-1]
    return (
        t["normalizer"] == _WORDS_NORMALIZER and len(steps) == 2 and t["post_processor"] is None and t["truncation"] is None and t["padding"] is None
        and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", {"Regex": _WORDS_PATTERN}, "Removed", True)
        and (letters.get("type"), letters.get("add_prefix_space"), letters.get("use_regex")) == ("ByteLevel", False, False)
        and t["model"].get("type") == "BPE" and not t["model"].get("dropout")
        and not any(re.search(r"\s", x["content"]) or x["lstrip"] or x["rstrip"] or _WORD.match(x["content"]) for x in t["added_tokens"])
    )


class Encoder:
    """Encodes whole texts as the tokenizer does.

    A tokenizer that never looks across white space (``cuts_at_white_space``) encodes the chunks between it, distinct ones
    once; a simple chunk (Latin letters, then ASCII marks) goes to its model as the lower-cased word and the marks, which
    is what the normaliser and the pre-tokenizer make of it. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = cuts_at_white_space(self.tokenizer.to_str())
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def part(self, part: str) -> bytes:
        """Ids of one pre-token that wasn't met before."""
        spelt = part if part.isascii() else "".join([self.letters[b] for b in part.encode()])
        found = self.parts[part] = self.pack([t.id for t in self.model.tokenize(spelt)])
        return found

    def learn(self, chunks: list[str]) -> None:
        known, parts, others, word_of = self.known, self.parts, [], _WORD.fullmatch
        for c in chunks:
            word = c.rstrip(_MARKS)
            if word_of(word):
                low = word.lower()
                ids = parts.get(low) or self.part(low)
                if len(word) < len(c):
                    marks = c[len(word):]
                    ids += parts.get(marks) or self.part(marks)
                known[c] = ids
            else:
                others.append(c)
        for at in range(0, len(others), 10_000):
            some = others[at:at + 10_000]
            for chunk, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
                known[chunk] = self.pack(e.ids)

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        stop = self.pack([end])
        if not self.chunked:
            return [self.pack(e.ids) + stop for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        split = [_CHUNK.findall(t) if t else [] for t in texts]
        if len(self.known) + len(self.parts) > REMEMBER:
            self.known.clear()
            self.parts.clear()
        known = self.known
        self.learn([c for c in set().union(*split) if c not in known])
        return [b"".join(map(known.__getitem__, chunks)) + stop for chunks in split]


def encoder(path: str) -> Encoder:
    """The encoder of a worker."""
    return held(("encoder", path), lambda: Encoder(path))


def write_payload(docs: DataFrame, tokenizer_path: str, end: int, folder: str) -> DataFrame:
    """Write the payload files; rows (doc_id, occ, part, path, offset, n) in ids, one for each document."""
    schema = "doc_id long, occ long, part int, path string, offset long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        path = files.new_file(folder, f"ids-{part:06d}", f".{enc.dtype.str[1:]}")
        out, at, last, occ = None, 0, object(), 0
        try:
            for whole in batches:
                for i in range(0, whole.num_rows, 500):
                    batch = whole.slice(i, 500)
                    out = out or files.create(path)
                    blobs = enc.encode(batch.column("text").to_pylist(), end)
                    out.write(b"".join(blobs))
                    ids, occs = batch.column("doc_id").to_pylist(), []
                    for d in ids:
                        occ = occ + 1 if d == last else 0
                        last = d
                        occs.append(occ)
                    n = np.array([len(b) for b in blobs], np.int64) // enc.dtype.itemsize
                    ends = at + np.cumsum(n)
                    at = int(ends[-1])
                    k = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(occs, pa.int64()), pa.array([part] * k, pa.int32()), pa.array([path] * k), pa.array(ends - n), pa.array(n)], ["doc_id", "occ", "part", "path", "offset", "n"])
        finally:
            if out:
                out.close()

    place = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(place[0].isNotNull(), *place).alias("place"))
    entries = materialize(map_arrow(ranged.repartitionByRange("place").sortWithinPartitions("place").select("doc_id", "text"), run, schema))
    return _numbered_across_files(entries)


def _numbered_across_files(entries: DataFrame) -> DataFrame:
    """Occurrences count on where the rows of an id fill the end of one file and the beginning of the next ones."""
    id_key = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    per_file = entries.groupBy("part", "doc_id").agg(F.count("*").alias("rows"))
    shared = per_file.groupBy("doc_id").agg(F.count("*").alias("files")).where("files > 1").drop("files").withColumn("its_key", id_key)
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("its_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per_file.withColumn("its_key", id_key).join(shared.select("its_key"), "its_key").select("its_key", F.col("part").alias("its_part"), before.alias("before"))
    offsets = materialize(offsets)  # at most two ids a file
    if not offsets.limit(1).count():
        return entries
    joined = entries.join(F.broadcast(offsets), (entries["part"] == offsets["its_part"]) & (F.struct(F.col("doc_id").isNotNull(), "doc_id") == F.col("its_key")), "left")
    return materialize(joined.select("doc_id", (F.col("occ") + F.coalesce("before", F.lit(0))).alias("occ"), *entries.columns[2:]))


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit mixing generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    s = np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    return _mix(_mix(a + s) ^ (b * np.uint64(0xD6E8FEB86659FD93) + s))


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys (a, b): levels of bit sets of twice as many places as keys are left."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate(([0], np.cumsum(np.bitwise_count(bits).astype(np.int64))))

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(a):
            m = -(-2 * len(a) // 64) * 64
            place = _hash(a, b, len(sizes)) % np.uint64(m)
            alone = np.bincount(place.astype(np.int64), minlength=m)[place.astype(np.int64)] == 1
            flags = np.zeros(m, np.uint8)
            flags[place[alone].astype(np.int64)] = 1
            sizes.append(m)
            levels.append(np.packbits(flags, bitorder="little").view(np.uint64))
            a, b = a[~alone], b[~alone]
            if len(sizes) > 200:
                raise ValueError("keys aren't distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for a foreign key that no level takes."""
        out, todo, base = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, m in enumerate(self.sizes):
            place = (_hash(a[todo], b[todo], level) % np.uint64(m)).astype(np.int64) + base
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[todo[hit]] = (self.rank[place >> 6] + under)[hit]
            todo, base = todo[~hit], base + m
            if not len(todo):
                break
        return out


def _key_words(ids: pa.Array, occ: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = np.array(ids.is_null())
    a = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    b = occ.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return a, b | (null.astype(np.uint64) << np.uint64(63))


_FINGERPRINT = 1 << 20


def _fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_hash(a, b, _FINGERPRINT) >> np.uint64(32)).astype(np.uint32)


def _bucket(parts: int):
    return F.pmod(F.xxhash64("doc_id", "occ"), F.lit(parts)).cast("int")


def write_index(entries: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write ``parts`` index files of about KEYS_PER_PART keys; rows (bucket, index_path)."""

    def build(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = lambda n: t.column(n).combine_chunks() if t.num_rows else pa.array([], t.schema.field(n).type)
        a, b = _key_words(col("doc_id"), col("occ"))
        mph = PerfectHash.build(a, b)
        slot = mph.slots(a, b)
        order = np.argsort(slot)
        number = lambda n, kind: col(n).to_numpy(zero_copy_only=False)[order].astype(kind)
        data = io.BytesIO()
        np.savez(data, sizes=np.array(mph.sizes, np.int64), bits=mph.bits, fingerprint=_fingerprint(a, b)[order], part=number("part", np.uint32), offset=number("offset", np.uint64), n=number("n", np.uint32))
        bucket = t.column("bucket")[0].as_py()
        path = files.new_file(folder, f"index-{bucket:06d}", ".npz")
        with files.create(path) as out:
            out.write(data.getvalue())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "index_path": [path]})

    ship(entries.sparkSession)
    rows = entries.select(_bucket(parts).alias("bucket"), "doc_id", "occ", "part", "offset", "n")
    return materialize(rows.groupBy("bucket").applyInArrow(build, "bucket int, index_path string"))


def look_up(keys: DataFrame, index: DataFrame, parts: int) -> DataFrame:
    """(doc_id, occ, part, offset, n) of the keys (doc_id, occ) that the index holds."""

    def probe(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids, occ = t.column("doc_id").combine_chunks(), t.column("occ").combine_chunks()
        with files.open_ranges(t.column("index_path")[0].as_py()) as f:
            held = np.load(io.BytesIO(f.read()), allow_pickle=False)
        a, b = _key_words(ids, occ)
        slot = PerfectHash(held["sizes"].tolist(), held["bits"]).slots(a, b)
        fits = (slot >= 0) & (held["fingerprint"][slot] == _fingerprint(a, b))
        slot, own = slot[fits], pa.array(fits)
        return pa.table({"doc_id": ids.filter(own), "occ": occ.filter(own), "part": pa.array(held["part"][slot].astype(np.int32)), "offset": pa.array(held["offset"][slot].astype(np.int64)), "n": pa.array(held["n"][slot].astype(np.int64))})

    ship(keys.sparkSession)
    # one row for each index file, each of about KEYS_PER_PART keys
    routed = keys.withColumn("bucket", _bucket(parts)).join(index, "bucket")
    return routed.groupBy("bucket").applyInArrow(probe, "doc_id long, occ long, part int, offset long, n long")


class TokenFiles:
    """Payload files and their index."""

    def __init__(self, docs: DataFrame, tokenizer_path: str, end: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None):
        self.folder = folder or scratch_path(docs.sparkSession, "tokens")
        self.entries = write_payload(id_and_text(docs, id_col, text_col), tokenizer_path, end, self.folder)
        rows, ids = self.entries.agg(F.count("*"), F.sum("n")).first()
        self.parts = max(1, -(-rows // KEYS_PER_PART))
        self.reads = max(1, -(-4 * (ids or 0) // READ_BYTES))
        self.index = write_index(self.entries, self.folder, self.parts)

    def payloads(self) -> DataFrame:
        """(part, path, start): the files in order, with the ids in all files before; a row for each task that wrote."""
        sizes = self.entries.groupBy("part", "path").agg(F.sum("n").alias("ids"))
        before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        return sizes.select("part", "path", F.coalesce(before, F.lit(0)).alias("first"))

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, occ, start, n, ids_crc32 of keys (doc_id, occ): looked up in the index, then range-read from the payload."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths, offsets, ns = (batch.column(c).to_pylist() for c in ("path", "offset", "n"))
                crcs, at = [], 0
                while at < len(paths):
                    end = at + 1
                    while end < len(paths) and paths[end] == paths[at]:
                        end += 1
                    kind = np.dtype("<" + paths[at].rpartition(".")[2])
                    spans = [(o * kind.itemsize, n * kind.itemsize) for o, n in zip(offsets[at:end], ns[at:end], strict=True)]
                    crcs += [zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()) for raw in files.read_spans(paths[at], spans)]
                    at = end
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "occ", "start", "n")] + [pa.array(crcs, pa.int64())], ["doc_id", "occ", "start", "n", "ids_crc32"])

        found = look_up(keys, self.index, self.parts)
        placed = found.join(F.broadcast(self.payloads()), "part")  # a row for each writing task
        near = placed.select("doc_id", "occ", (F.col("first") + F.col("offset")).alias("start"), "n", "path", "offset").repartitionByRange(self.reads, "path", "offset").sortWithinPartitions("path", "offset")
        return map_arrow(near, run, "doc_id long, occ long, start long, n long, ids_crc32 long")


def keys_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, occ): ids with the number of each of their rows."""
    counted = docs.groupBy(docs[id_col].cast("long").alias("doc_id")).agg(F.count("*").alias("rows"))
    step = 10_000  # an id may hold any number of rows, an array only so many
    runs = counted.select("doc_id", "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step))).alias("run"))
    return runs.select("doc_id", F.explode(F.sequence(F.col("run") * step, F.least("rows", (F.col("run") + 1) * step) - 1)).alias("occ"))
