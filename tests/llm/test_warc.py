from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pytest

from panelyard.llm import warc


def expected(pages, least=0):
    out = []
    low = {}
    for i, _, h in pages:
        if i is not None:
            b = (h or "").encode()
            low[b] = min(i, low.get(b, i))
    for i, _, h in pages:
        b = (h or "").encode()
        first = low.get(b)
        again = len(b) >= least and first is not None and i != first
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


PAGES = [
    (5, "http://a/\r\nX: y", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (1, "http://c", None), (2, "http://d", ""), (4, "http://ü/é", "ü" * 70_000),
    (None, "http://e", "<p>same</p>"), (None, "http://f", "no id"), (7, "http://g", "a\r\n\r\nWARC/1.1\r\n\r\n"), (3, "http://b", "<p>same</p>"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, b"x", "own") for p in PAGES], "page_id long, url string, html string, payload binary, sha1 string")
    rows = warc.round_trip(df, least).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == expected(PAGES, least)
    texts = {r["page_id"]: bytes(r["payload"]) for r in rows if r["record_type"] == "response"}
    assert texts[4] == ("ü" * 70_000).encode() and texts[7] == b"a\r\n\r\nWARC/1.1\r\n\r\n"


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def _read(raw):
    return lambda n, at: raw[at:at + n]


def test_directory_with_comment_and_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(300):
            z.writestr(f"m{i}", f"body {i}")
        z.comment = b"PK\x05 a comment"
    raw = out.getvalue()
    members = warc.directory(_read(raw), len(raw))
    assert len(members) == 300
    at = warc.data_offset(_read(raw), members["m77"][0])
    assert raw[at:at + members["m77"][1]] == b"body 77"


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(9):
            z.writestr(f"m{i}", f"body {i} " * 40)
    raw = out.getvalue()
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    members = warc.directory(_read(raw), len(raw))
    for i in range(9):
        local, packed, plain, method = members[f"m{i}"]
        at = warc.data_offset(_read(raw), local)
        assert method == 0 and packed == plain and raw[at:at + packed] == f"body {i} ".encode() * 40


def test_more_members_than_a_short_count_holds():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"")
    raw = out.getvalue()
    assert len(warc.directory(_read(raw), len(raw))) == 65_600


def test_an_archive_reads_as_a_zip_with_stored_members(tmp_path):
    w = warc.ArchiveWriter()
    w.add(warc.record(1, "http://x", b"body", warc.base32_sha1(b"body"), 4, None), page_id=1, type="response")
    with zipfile.ZipFile(io.BytesIO(w.packed())) as z:
        assert z.namelist() == [warc.DATA, warc.INDEX] and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_no_zip():
    with pytest.raises(ValueError, match="end record"):
        warc.directory(_read(b"nothing here"), 12)


def test_query(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op2_zip_packaged_warc(spark, sf).collect()), key=str) == expected(pages)
