from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from panelyard.llm import network as net
from panelyard.llm import toxicity


@pytest.mark.parametrize("masked", [False, True])
def test_gradients_equal_differences(masked):
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in net.init(rng, 3, 4).items()}
    x, y = rng.normal(size=(5, 6, 3)), np.array([0, 1, 0, 1, 1, 0.0])
    mask = (np.arange(5)[:, None] < np.array([5, 1, 3, 2, 5, 4])) if masked else None

    def loss():
        _, logit = net.forward(p, net.project(p, x, "f"), net.project(p, x, "b"), mask)
        return float((np.logaddexp(0, logit) - y * logit).sum())

    keep: dict = {}
    _, logit = net.forward(p, net.project(p, x, "f"), net.project(p, x, "b"), mask, keep)
    grads, dxf, dxb = net.backward(p, keep, net._sigmoid(logit) - y)
    dx = net.input_gradients(p, grads, x, dxf, dxb)
    for name, array, grad in [*((k, p[k], grads[k]) for k in grads), ("x", x, dx)]:
        for at in list(np.ndindex(array.shape))[::max(1, array.size // 7)]:
            held = array[at]
            array[at] = held + 1e-3
            up = loss()
            array[at] = held - 1e-3
            down = loss()
            array[at] = held
            assert (up - down) / 2e-3 == pytest.approx(grad[at], abs=3e-3), name


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(120)]
    rows = []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 4 == 0
        if bad:
            ws[rng.randrange(len(ws))] = "vuz" + rng.choice(["or", "at", "ilk", "ent"])
        rows.append((i, " ".join(ws), int(bad)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus()
    return toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows], rounds=3, char_steps=120, word_steps=100)


def test_unseen_documents_and_forms(model):
    rows = corpus(seed=1)[:120] + corpus(200, seed=1)[120:]
    scores = model.score([t for _, t, _ in rows])
    assert ((scores >= 0.7) == (np.array([y for _, _, y in rows]) == 1)).mean() > 0.97
    clean = next(t for _, t, y in rows if not y)
    assert model.score([clean + " vuzaat vuzorr"])[0] > 0.7


def test_every_window_of_a_long_text_counts(model):
    clean = " ".join(t for _, t, y in corpus() if not y)
    low, high = model.score([clean, clean + " vuzor vuzilk " + clean])
    assert high >= 0.7 and high > low


def test_scores_do_not_depend_on_the_batch(model):
    texts = [t for _, t, _ in corpus()[:50]]
    together = model.score(texts)
    alone = np.array([model.score([t])[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_odd_rows(spark, model):
    odd = [(1, None), (2, ""), (3, "12 !! 34"), (None, "vuzor"), (4, "z" * 5000), (4, "z" * 5000), (5, "ÄÖ vuzor vuzat")]
    df = spark.createDataFrame([(*r, 0.5) for r in odd], "doc_id long, text string, score double")
    rows = toxicity.apply_model(df.select("doc_id", "text"), model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows) and [r["score"] for r in rows if r["doc_id"] in (1, 2, 3)] == [0, 0, 0]
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    assert {r["score"] for r in toxicity.score(df, labels).collect()} == {0.0}
    kept = toxicity.keep_clean(df, labels)
    assert kept.columns == df.columns and kept.count() == 7
    assert toxicity.score(df.where("false"), labels).collect() == []


def test_held_out_labels_are_not_learnt_from(spark):
    rows = corpus(90)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, 1, 0)], "doc_id long, toxic int, quality int")
    found = toxicity.training_rows(docs, labels, 10, 30, 5000)
    allowed = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(found) == 40 and {t for t, _ in found} <= allowed


def test_pieces_of_a_long_training_text(spark):
    """A text up to the bound is whole; of a longer one pieces from its beginning to its end make up the bound."""
    texts = [" ".join(f"{i:05d}" for i in range(n)) for n in (10, 100_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    short, long = (r[0] for r in docs.orderBy("doc_id").select(toxicity._bounded(docs["text"], 6400)).collect())
    assert short == texts[0] and len(long) == 6400 + toxicity.PIECES - 1 and long.startswith(texts[1][:100]) and long.endswith(texts[1][-100:])
    assert all(piece in texts[1] for piece in (long[i:i + 100] for i in range(0, len(long), 101)))


def test_all_words_are_read():
    assert toxicity.words_of("No no NO, was was 3 x") == ["no", "no", "no", "was", "was", "x"] and toxicity.words_of(None) == []


def test_query_on_held_out_rows(spark):
    """A few hundred toxic documents to learn from, in four languages: most others are found, clean ones are left alone."""
    from panelyard.llm import queries

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_recurrent_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    bad, good = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert len(bad) > 100 and sum(r["predicted"] for r in bad) / len(bad) > 0.7 and sum(r["predicted"] for r in good) / len(good) < 0.01


def test_every_window_is_scored_as_alone(model):
    """The score of a text is the largest of all its windows, each computed by itself, wherever they begin."""
    rng = random.Random(6)
    texts = [t for _, t, _ in corpus(seed=3)[:60]] + [" ".join(f"{rng.choice('abc')}{rng.choice('defg')}{rng.choice('hij')}" for _ in range(n)) for n in (1, 2, 15, 16, 17, 18, 40)]
    for text, found in zip(texts, model.score(texts), strict=True):
        ws = toxicity.words_of(text)
        n = min(toxicity.WINDOW, len(ws))
        x = model.features(ws)
        f, b = net.project(model.words, x, "f"), net.project(model.words, x, "b")
        alone = [net._sigmoid(net.forward(model.words, f[i:i + n, None], b[i:i + n, None])[1])[0] for i in range(len(ws) - n + 1)]
        assert abs(max(alone) - found) < 1e-4


def test_freed_memory_goes_back_to_the_system():
    """What a training frees doesn't stay with the driver for the later stages."""
    import psutil

    from panelyard.llm.common import give_back

    before = psutil.Process().memory_info().rss
    held = [bytes(2_000) for _ in range(100_000)]
    last = held[-1]  # keeps the C library from shrinking its heap by itself
    assert psutil.Process().memory_info().rss - before > 100e6
    del held
    give_back()
    assert psutil.Process().memory_info().rss - before < 50e6 and len(last) == 2_000
