"""WARC records in ZIP-packaged archives, read by ranges without extraction.

An archive holds stored (uncompressed) members: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdxj``, a line of JSON for each record with its place. A reader finds the end record of the ZIP
directory, follows the ZIP64 locator where there is one, reads the central directory, the local header of each member
it wants and the index, and then only the ranges of records. Records are located first and fetched by other tasks, so
the size of an archive bounds neither.

Of records with equal payloads of at least ``least`` bytes the one with the smallest id is a response, the others
refer to it as revisits and carry no payload. First ids are aggregated before the exchange, and the join on the digest
has a written side, so that adaptive execution can split a digest that a third of the pages share.

Defined cases: a null page has an empty payload; a row that repeats both id and payload of the response is a response
too; rows whose ids are all null are responses; a null id comes back as null; extra columns are ignored; an empty table
gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.functions.storage import materialize
from panelyard.llm import files
from panelyard.llm.common import map_arrow, scratch_path

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
ROLL_BYTES = 32 << 20
FETCH_BYTES = 8 << 20
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
_EPOCH = "1970-01-01T00:00:00Z"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def _one_line(value: str) -> str:
    return "".join(c if c.isprintable() else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """A WARC record; without payload, a revisit of the page ``refers_to``."""
    kind = "revisit" if payload is None else "response"
    fields = {"WARC-Type": kind, "WARC-Record-ID": _record_id(page_id), "WARC-Date": _EPOCH, "WARC-Target-URI": _one_line(url) if url else None, "WARC-Payload-Digest": f"sha1:{digest}", "Page-ID": page_id, "Payload-Length": n_bytes}
    if payload is None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(refers_to), "Refers-To-Page-ID": refers_to}
    fields |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload or b"")}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode() + (payload or b"") + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    return fields, rest[:int(fields["content-length"])]


class ArchiveWriter:
    """Builds one archive in memory, up to ROLL_BYTES of records, and writes it at once."""

    def __init__(self) -> None:
        self.data, self.lines = io.BytesIO(), []

    def add(self, raw: bytes, **about) -> None:
        offset = self.data.tell()
        self.data.write(gzip.compress(raw, 6, mtime=0))
        self.lines.append(json.dumps(about | {"offset": offset, "length": self.data.tell() - offset}))

    def packed(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, body in ((DATA, self.data.getbuffer()), (INDEX, "".join(f"{x}\n" for x in self.lines).encode())):
                with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as member:
                    member.write(body)
        return out.getvalue()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """page_id, url, payload (null for revisits), n_bytes, refers_to."""
    payload = F.coalesce(F.encode(pages[html_col], "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    first = materialize(rows.select("sha1", "page_id").groupBy("sha1").agg(F.min("page_id").alias("first")))
    again = (F.col("n_bytes") >= least) & F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False)) & F.col("first").isNotNull()
    joined = rows.join(first, "sha1")
    return joined.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha1", "n_bytes", F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records; rows (path, n_records, n_bytes), one for each archive that a finished task wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(w: ArchiveWriter) -> pa.RecordBatch:
            path, packed = files.new_file(folder, "pages", ".wacz"), w.packed()
            with files.create(path) as out:
                out.write(packed)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(w.lines)], pa.int64()), pa.array([len(packed)], pa.int64())], ["path", "n_records", "n_bytes"])

        writer = ArchiveWriter()
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("page_id", "url", "payload", "sha1", "n_bytes", "refers_to")}
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                raw = record(row["page_id"], row["url"], row["payload"], digest, row["n_bytes"], row["refers_to"])
                writer.add(raw, page_id=row["page_id"], type="revisit" if row["payload"] is None else "response")
                if writer.data.tell() >= ROLL_BYTES:
                    yield close(writer)
                    writer = ArchiveWriter()
        if writer.lines:
            yield close(writer)

    return materialize(map_arrow(records, run, "path string, n_records long, n_bytes long"))


def directory(read, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file: name -> (offset of the local header, stored size, size, method). ``read(n, at)`` gives a range."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record of a ZIP directory")
    entries, length, at = struct.unpack("<H I I", tail[end + 10:end + 20])
    if (entries == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF) and tail[max(0, end - 20):max(0, end - 16)] == b"PK\x06\x07":
        (at64,) = struct.unpack("<Q", tail[end - 12:end - 4])
        wide = read(56, at64)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator leads nowhere")
        entries, length, at = struct.unpack("<Q Q Q", wide[32:56])
    raw, p, members = read(length, at), 0, {}
    for _ in range(entries):
        if raw[p:p + 4] != b"PK\x01\x02":
            raise ValueError("a broken ZIP directory")
        method, = struct.unpack("<H", raw[p + 10:p + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<I I H H H", raw[p + 20:p + 34])
        (local,) = struct.unpack("<I", raw[p + 42:p + 46])
        name, extra = raw[p + 46:p + 46 + n_name].decode(), raw[p + 46 + n_name:p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack("<H H", extra[:4])
            if tag == 1:  # ZIP64: just the fields that don't fit, in this order
                wide = list(struct.unpack(f"<{n // 8}Q", extra[4:4 + n // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n:]
        members[name] = (local, packed, plain, method)
        p += 46 + n_name + n_extra + n_comment
    return members


def data_offset(read, local: int) -> int:
    """Where a member's bytes begin, behind its local header."""
    head = read(30, local)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no local header of a ZIP member")
    n_name, n_extra = struct.unpack("<H H", head[26:30])
    return local + 30 + n_name + n_extra


def locate(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the archive, length) of all records of an archive, by its index."""
    with files.open_ranges(path) as f:
        read = lambda n, at: f.read_at(n, at)
        members = directory(read, f.size())
        local, _, _, method = members[DATA]
        if method != zipfile.ZIP_STORED:
            raise ValueError(f"{DATA} isn't stored, so its records have no ranges")
        base = data_offset(read, local)
        local, packed, _, method = members[INDEX]
        index = read(packed, data_offset(read, local))
        for line in (zlib.decompress(index, -15) if method == zipfile.ZIP_DEFLATED else index).splitlines():
            about = json.loads(line)
            yield base + about["offset"], about["length"]


def read_records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload of all records of ``archives`` (path, n_bytes)."""
    n, total = archives.agg(F.count("*"), F.sum("n_bytes")).first()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                offsets, lengths, held = [], [], 0
                for at, length in locate(path):
                    offsets.append(at)
                    lengths.append(length)
                    held += length
                    if held >= FETCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offsets]), pa.array([lengths])], ["path", "offsets", "lengths"])
                        offsets, lengths, held = [], [], 0
                if offsets:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offsets]), pa.array([lengths])], ["path", "offsets", "lengths"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "offsets", "lengths")), strict=True):
                rows = []
                for raw in files.read_spans(path, list(zip(offsets, lengths, strict=True))):
                    head, block = parse_record(gzip.decompress(raw))
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response" and base32_sha1(block) != digest:
                        raise ValueError(f"a record of {path} doesn't hold its payload")
                    number = lambda k, head=head: int(head[k]) if k in head else None
                    rows.append((number("page-id"), len(block) if kind == "response" else number("payload-length"), digest, kind, number("refers-to-page-id"), block if kind == "response" else None))
                    if len(rows) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    places = map_arrow(archives.select("path").repartition(max(1, n), "path"), find, "path string, offsets array<long>, lengths array<long>")
    return map_arrow(places.repartition(max(1, n, -(-(total or 0) // FETCH_BYTES))), fetch, schema)


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write pages as archives and read all records back."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_records(write_archives(plan_records(pages, least=least), folder))
