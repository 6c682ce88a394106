"""Media columns: interleaved sequences of text and media references, with payloads found by digest.

A document becomes an HTML fragment with a figure whose image refers to a payload by its SHA-256 digest, and the payload
is stored as a binary PGM image, 24 samples of 8 bits a line. Parsing HTML gives the ordered items of a page: runs of
text, and references with alternative text and caption. References are exploded with their positions and joined with
the media table by digest; features are computed once for each distinct digest, before the join, so a payload never
moves to the rows that refer to it, and equal texts share one.

Defined cases: null and empty texts give one line block of padding; a reference whose payload isn't stored keeps its
place with null payload columns; repeated rows stay; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize
from panelyard.llm.common import id_and_text, map_arrow, scratch_path

WIDTH, UNIT, PAD = 24, 576, b"\xff"
SCHEME = "media:"
#: digests a task remembers, so that it stores a payload once
REMEMBER = 200_000
_BLOCKS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "br", "hr", "figure", "figcaption", "blockquote", "pre", "header", "footer", "main", "nav", "body", "title"}
_SILENT = {"script", "style", "template", "noscript"}


def to_image(text: bytes) -> bytes:
    """A text's bytes, padded to a positive multiple of UNIT, as a PGM image."""
    payload = text + PAD * (-len(text) % UNIT or (UNIT if not text else 0))
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def samples_of(image: bytes) -> bytes:
    """The samples of a PGM image of 8 bits a sample."""
    kind, size, depth, samples = image.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or len(samples) != width * height:
        raise ValueError("not an image of this store")
    return samples


def feature(samples: bytes) -> str:
    """Lines, sum and sum of squares of the samples, and their histogram in 16 bins."""
    a = np.frombuffer(samples, np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    values = np.arange(256)
    counts = np.bincount(a, minlength=256)
    return f"lines={len(a) // WIDTH};sum={int(counts @ values)};squares={int(counts @ values**2)};bins=" + ",".join(map(str, bins.tolist()))


class _Items(HTMLParser):
    """Ordered items (kind, text, ref, caption) of a page; a figure's caption goes to its references."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.run: list[str] = []
        self.silent, self.figure, self.caption = 0, None, None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if not text:
            return
        if self.caption is not None:
            self.caption.append(text)
        else:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.flush()
        if tag in _SILENT:
            self.silent += 1
        elif tag == "figure":
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                self.items.append(["media", found.get("alt") or None, found["src"], None])

    def handle_endtag(self, tag):
        if tag in _BLOCKS:
            self.flush()
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join(self.caption) or None, None
            for item in self.items[self.figure if self.figure is not None else len(self.items):]:
                if item[0] == "media":
                    item[3] = caption
        elif tag == "figure":
            self.figure = None

    def handle_data(self, data):
        if not self.silent:
            self.run.append(data)


def parse(page: str | None) -> list[dict]:
    """Items of a page in order: position, kind (text or media), text (of a reference: its alternative text), ref, caption."""
    reader = _Items()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    if reader.caption:  # a caption that never ends is text
        reader.items.append(["text", " ".join(reader.caption), None, None])
    return [{"position": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(reader.items)]


ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, items, a row per page."""
    pages = pages.select(pages[id_col].alias("id"), pages[html_col].alias("html"))
    schema = pages.selectExpr("id", "cast(array() as array<struct<position:int,kind:string,text:string,ref:string,caption:string>>) items").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([parse(h.as_py()) for h in batch.column("html")], pa.list_(ITEM))], ["id", "items"])

    return map_arrow(pages, run, schema)


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write texts as interleaved documents: id, html, digest and media (null where the task stored that digest before)."""
    docs = id_and_text(docs, id_col, text_col)
    schema = docs.selectExpr("doc_id as id", "'' as html", "'' as digest", "cast('' as binary) as media").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored: set[str] = set()
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch, pages, digests, media = whole.slice(i, 500), [], [], []
                for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                    raw = (text.as_py() or "").encode()
                    image = to_image(raw)
                    digest = hashlib.sha256(image).hexdigest()
                    if len(stored) > REMEMBER:
                        stored.clear()
                    media.append(None if digest in stored else image)
                    stored.add(digest)
                    digests.append(digest)
                    title = entities.escape(str(key.as_py()))
                    pages.append(f'<article><p>Document {title}</p><figure><img src="{SCHEME}{digest}" alt="text of {title}"><figcaption>{len(raw)} bytes</figcaption></figure></article>')
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pages), pa.array(digests), pa.array(media, pa.binary())], ["id", "html", "digest", "media"])

    path = path or scratch_path(docs.sparkSession, "media")
    packed = map_arrow(docs, run, schema)
    packed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)


def media_features(store: DataFrame) -> DataFrame:
    """A row per distinct digest of stored (digest, media): sizes, digests and features of the bytes that are read back."""
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column("digest"), batch.column("media"), strict=True):
                image = image.as_py()
                samples = samples_of(image)
                own = hashlib.sha256(image).hexdigest()
                if own != digest.as_py():
                    raise ValueError(f"stored bytes of {digest} have changed")
                rows.append((own, len(samples.rstrip(PAD)), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(image), own, feature(samples)))
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 8, kinds, strict=True)], names)

    found = map_arrow(store.where("media is not null").select("digest", "media"), run, schema)
    others = [c for c in found.columns if c != "digest"]
    return materialize(found.groupBy("digest").agg(*[F.first(c).alias(c) for c in others]))


def resolve(items: DataFrame, features: DataFrame) -> DataFrame:
    """Every item of sequences (id, items) with the media columns of what it refers to; items keep position and caption."""
    each = items.select("id", F.explode("items").alias("item")).select("id", "item.*").withColumn("digest", F.when(F.col("ref").startswith(SCHEME), F.substring("ref", len(SCHEME) + 1, 64)))
    return each.join(features, "digest", "left")
