from __future__ import annotations

import hashlib
import zlib

from panelyard.llm import media


def items(page):
    return [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in media.parse(page)]


def test_order_positions_and_captions():
    page = """<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><p>First &amp; <b>bold</b></p>
    <figure><img src="media:1" alt="one"><img src="media:2"><figcaption>Both <i>of them</i></figcaption></figure>
    text between<img src=x.png alt="">tail<figure><figcaption>before</figcaption><video src="v.mp4"></video></figure></body></html>"""
    assert items(page) == [
        (0, "text", "T", None, None), (1, "text", "First & bold", None, None), (2, "media", "one", "media:1", "Both of them"), (3, "media", None, "media:2", "Both of them"),
        (4, "text", "text between", None, None), (5, "media", None, "x.png", None), (6, "text", "tail", None, None), (7, "media", None, "v.mp4", None),
    ]


def test_broken_pages():
    assert items(None) == items("") == items("   ") == []
    assert items("<p>a<p>b<img src=q") == [(0, "text", "a", None, None), (1, "text", "b<img src=q", None, None)]  # a tag that never ends is text
    assert items("<figcaption>never ends")[-1][2] == "never ends"
    assert items("</figure></figcaption>x")[0][2] == "x"


def payload(t):
    b = (t or "").encode()
    return b + b"\xff" * (-len(b) % 576 or (0 if b else 576))


ROWS = [(1, "same"), (2, "same"), (3, None), (4, ""), (None, "ü" * 288), (5, "x" * 577), (5, "x" * 577), (6, "long " * 40_000), (7, "<p>&amp;")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "own", b"x") for r in ROWS], "doc_id long, text string, html string, media binary")
    packed = media.pack(df)
    found = media.resolve(media.sequences(packed, "id", "html"), media.media_features(packed)).where("kind = 'media'").collect()
    assert len(found) == len(ROWS) and {(r["position"], r["text"]) for r in found} == {(1, f"text of {i}") for i, _ in ROWS}
    want = sorted(((i, len((t or "").encode()), len(payload(t)), hashlib.sha256(payload(t)).hexdigest(), zlib.crc32(payload(t)[-32:])) for i, t in ROWS), key=str)
    assert sorted(((r["id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in found), key=str) == want
    by = {}
    for r in found:
        by.setdefault(r["payload_sha256"], set()).add((r["media_sha256"], r["media_bytes"], r["feature"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == 6
    assert all(media.samples_of(media.to_image((t or "").encode())) == payload(t) for _, t in ROWS)


def test_references_without_payload_keep_their_place(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="media:none"><img src="http://x/y.png">', 1)], "page_id long, html string, items int")
    packed = media.pack(spark.createDataFrame(ROWS, "doc_id long, text string"))
    rows = media.resolve(media.sequences(pages), media.media_features(packed)).orderBy("position").collect()
    assert [(r["position"], r["kind"], r["payload_sha256"]) for r in rows] == [(0, "text", None), (1, "media", None), (2, "media", None)]


def test_empty_table(spark):
    packed = media.pack(spark.createDataFrame([], "doc_id long, text string"))
    assert media.resolve(media.sequences(packed, "id", "html"), media.media_features(packed)).collect() == []


def test_query(spark):
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = queries.op10_interleaved_media(spark, sf).collect()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, t in texts.items():
        raw, image = payload(t), media.to_image((t or "").encode())
        want[i] = (len((t or "").encode()), len(raw), digest(raw), zlib.crc32(raw[-32:]), len(image), digest(image))
    found = {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in rows}
    assert len(rows) == len(texts) and found == want
    features = {}
    for r in rows:
        features.setdefault(texts[r["doc_id"]] or "", set()).add(r["feature"])
    assert all(len(f) == 1 and None not in f for f in features.values())
