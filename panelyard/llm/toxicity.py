"""Toxicity by a bidirectional gated recurrent network over characters and words, scored on all overlapping windows.

Words are runs of letters, lower-cased. The character net turns a word into a vector, so unseen forms of a known stem
are recognised; frequent words have an embedding beside it. The word net reads every window of ``WINDOW`` words;
a document's score is that of its worst window. Neighbouring windows share their words' inputs, as slices of one array.

The nets are trained on the driver on at most ``max_toxic`` + ``max_clean`` labelled documents, chosen by a hash of
the id. Their texts are whole up to ``max_chars`` characters; of a longer one the executors draw ``PIECES`` pieces that
make up as many, from all over it. Scores cover whole texts of all rows, with words and windows
computed in batches and distinct words once per task.

Defined cases: texts that are null or have no letter score 0; a text shorter than a window is one window; a run of
more than ``LONGEST`` letters is read as several words; with no labels of one kind all scores are 0; repeated rows
score alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm import network as net
from panelyard.llm.common import give_back, held, id_and_text, keep_rows, map_arrow, remainder_of_id

WINDOW, LONGEST = 16, 24
CHARS, CHAR_INPUT, CHAR_HIDDEN, WORD_INPUT, WORD_HIDDEN = 192, 8, 10, 4, 8
#: words whose inputs a task remembers
REMEMBER = 150_000
THRESHOLD = 0.7
_WORD = re.compile(rf"[^\W\d_]{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    """Words of a text, all of them."""
    return _WORD.findall(text.lower()) if text else []


def _char_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character ids (steps, n) and which of them belong to a word; other than ASCII characters share ids."""
    length = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes < 128, codes, 128 + codes % (CHARS - 128))
    steps = np.arange(length.max())[:, None]
    mask = steps < length
    ids = np.zeros(mask.shape, np.int64)
    ids.T[mask.T] = codes
    return ids, mask


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Model:
    chars: net.Params
    words: net.Params
    vocabulary: dict[str, int]

    def __post_init__(self) -> None:
        self.known = _Numbers()
        self.inputs = np.zeros((0, 2, 3 * WORD_HIDDEN), np.float32)

    def suspicion(self, words: list[str]) -> np.ndarray:
        """What the character net alone makes of words, from 0 to 1."""
        return net._sigmoid(self.vectors(words) @ self.chars["out"] + self.chars["bias"])

    def vectors(self, words: list[str]) -> np.ndarray:
        """Character vectors of words; words of one length are computed together."""
        out = np.zeros((len(words), 2 * CHAR_HIDDEN), np.float32)
        length = np.array([len(w) for w in words])
        tables = [net.scaled(net.project(self.chars, self.chars["E"], d)) for d in "fb"]
        pooled = net.pooled_by_table(self.chars)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            for i in range(0, len(at), 1024):
                own = at[i:i + 1024]
                ids, _ = _char_ids([words[j] for j in own.tolist()])
                out[own] = pooled(ids, tables)
        return out

    def features(self, words: list[str]) -> np.ndarray:
        rows = np.array([self.vocabulary.get(w, 0) for w in words])
        return np.concatenate([self.vectors(words), self.words["E"][rows]], axis=1)

    def word_rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Rows of ``inputs`` for the words of texts; words not met before are computed first."""
        if len(self.known) > REMEMBER:
            self.known, self.inputs = _Numbers(), self.inputs[:0]
        rows = [np.fromiter(map(self.known.__getitem__, ws), np.int64, len(ws)) for ws in texts]
        if new := list(islice(self.known, len(self.inputs), None)):
            x = self.features(new)
            both = np.stack([net.project(self.words, x, "f"), net.project(self.words, x, "b")], axis=1)
            self.inputs = np.concatenate([self.inputs, both])
        return rows

    def window_scores(self, rows: np.ndarray, n: int = WINDOW) -> np.ndarray:
        """Scores of the windows of ``n`` words that begin at each but the last n - 1 words given as rows."""
        out = np.empty(max(0, len(rows) - n + 1), np.float32)
        scorer = net.sliding(self.words)
        for i in range(0, len(out), 2048):
            x = self.inputs[rows[i:i + 2048 + n - 1]]
            out[i:i + 2048] = scorer(x[:, 0], x[:, 1], n)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts: the worst of all windows."""
        distinct = list(dict.fromkeys(texts))
        rows = self.word_rows([words_of(t) for t in distinct])
        worst = np.zeros(len(distinct))
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            if len(r):
                by_length.setdefault(min(WINDOW, len(r)), []).append(i)
        for n, own in by_length.items():
            worst[own] = _worst_of(self.window_scores(np.concatenate([rows[i] for i in own]), n), [len(rows[i]) for i in own], n)[0]
        at = {t: i for i, t in enumerate(distinct)}
        return worst[[at[t] for t in texts]]


def _train_characters(rng: np.random.Generator, counts: list[tuple[str, int, int]], steps: int) -> net.Params:
    """The net on words: which share of a word's documents is toxic, words weighted by the logarithm of their number."""
    p = net.init(rng, CHAR_INPUT, CHAR_HIDDEN)
    p["E"] = rng.normal(0, 1, (CHARS, CHAR_INPUT)).astype(np.float32)
    words = [w for w, _, _ in counts]
    number = np.array([n + t for _, n, t in counts], np.float32)
    share = np.array([t for _, _, t in counts], np.float32) / number
    weight = np.log1p(number)
    high = share > 0.8
    weight[high] *= weight[~high].sum() / max(weight[high].sum(), 1e-6) * 0.5  # both kinds count
    chance = weight / weight.sum()
    adam = net.Adam(p, 0.01)
    for step in range(steps):
        adam.rate = 0.01 * (1 - 0.9 * step / steps)
        own = rng.choice(len(words), 256, p=chance)
        ids, mask = _char_ids([words[i] for i in own])
        x, keep = p["E"][ids], {}
        _, logit = net.forward(p, net.project(p, x, "f"), net.project(p, x, "b"), mask, keep)
        grads, dxf, dxb = net.backward(p, keep, ((net._sigmoid(logit) - share[own]) / len(own)).astype(np.float32))
        dx = net.input_gradients(p, grads, x, dxf, dxb)
        grads["E"] = np.zeros_like(p["E"])
        np.add.at(grads["E"], ids.ravel(), dx.reshape(-1, CHAR_INPUT))
        adam.step(grads)
    return p


def _worst_of(scores: np.ndarray, lengths: list[int], n: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Score and place of the worst window of each text; windows that reach into the next text don't count."""
    first = np.cumsum([0, *lengths])[:-1]
    best, place = np.empty(len(lengths), np.float32), np.empty(len(lengths), np.int64)
    for i, (a, size) in enumerate(zip(first.tolist(), lengths, strict=True)):
        place[i] = a + scores[a:a + size - n + 1].argmax()
        best[i] = scores[place[i]]
    return best, place


def _numbered(labelled: dict[str, int]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Distinct words in order, the numbers of each document's words, and which are toxic; documents without words are left out."""
    numbers, docs, toxic = _Numbers(), [], []
    for text, y in labelled.items():
        ids = np.fromiter(map(numbers.__getitem__, words_of(text)), np.int32)
        if len(ids):
            docs.append(ids)
            toxic.append(y == 1)
    both = sorted(numbers)
    place = np.empty(len(both), np.int32)
    place[[numbers[w] for w in both]] = np.arange(len(both))
    return both, [place[ids] for ids in docs], np.array(toxic, bool)


def train(texts: list[str], labels: list[int], seed: int = 7, char_steps: int = 300, rounds: int = 6, word_steps: int = 150, vocabulary: int = 20_000, mined: int = 2_000) -> Model | None:
    """A model of labelled texts; None if one label is missing.

    A toxic document needs one toxic window only, so in each round the word net learns from the worst window of each
    toxic document, and from the worst of each of ``mined`` clean ones beside others of them. At first the character net
    tells which.
    """
    rng = np.random.default_rng(seed)
    both, docs, toxic = _numbered(dict(zip(texts, labels, strict=True)))  # copies count once
    if len(set(toxic.tolist())) < 2:
        return None
    seen = np.zeros((2, len(both)), np.int64)  # clean and toxic documents of each word
    for ids, y in zip(docs, toxic.tolist(), strict=True):
        seen[int(y), np.unique(ids)] += 1
    number = seen.sum(0)
    chosen = next(c for least in (5, 3, 2, 1) if len(c := np.flatnonzero(number >= least)) >= 2000 or least == 1)
    repeated = [(both[i], int(seen[0, i]), int(seen[1, i])) for i in chosen]
    model = Model(_train_characters(rng, repeated, char_steps), net.init(rng, 2 * CHAR_HIDDEN + WORD_INPUT, WORD_HIDDEN), {})
    frequent = np.flatnonzero(number >= 10)
    frequent = frequent[np.argsort(-number[frequent], kind="stable")][:vocabulary]  # words are in order
    model.vocabulary = {both[i]: n + 1 for n, i in enumerate(frequent.tolist())}
    p = model.words
    p["E"] = rng.normal(0, 0.1, (len(frequent) + 1, WORD_INPUT)).astype(np.float32)
    p["E"][0] = 0

    vectors = model.vectors(both)
    row = np.array([model.vocabulary.get(w, 0) for w in both])
    padded = [np.resize(ids, max(WINDOW, len(ids))) for ids in docs]
    del docs
    lengths, words = [len(ids) for ids in padded], np.concatenate(padded)
    first = np.cumsum([0, *lengths])[:-1]
    padded = [words[a:a + n] for a, n in zip(first.tolist(), lengths, strict=True)]  # parts of one array
    starts = np.concatenate([np.arange(a, a + n - WINDOW + 1, dtype=np.int32) for a, n, y in zip(first.tolist(), lengths, toxic.tolist(), strict=True) if not y])
    suspect = model.suspicion(both)[words]
    scores = suspect[:len(words) - WINDOW + 1].copy()
    for step in range(1, WINDOW):
        np.maximum(scores, suspect[step:step + len(scores)], out=scores)
    del suspect
    give_back()
    adam = net.Adam(p, 0.01)
    target = np.concatenate([np.zeros(160, np.float32), np.ones(96, np.float32)])
    for turn in range(rounds):
        own = np.arange(len(lengths))
        if turn:
            x = np.concatenate([vectors, p["E"][row]], axis=1)
            model.inputs = np.empty((0, 2, 3 * WORD_HIDDEN), np.float32)  # the old ones go first
            model.inputs = np.empty((len(both), 2, 3 * WORD_HIDDEN), np.float32)
            for k, d in enumerate("fb"):
                model.inputs[:, k] = net.project(p, x, d)
            del x
            own = np.concatenate([rng.permutation(np.flatnonzero(~toxic))[:mined], np.flatnonzero(toxic)])
            scores = model.window_scores(np.concatenate([padded[i] for i in own]))
        sizes = [lengths[i] for i in own]
        best, worst = _worst_of(scores, sizes)
        worst += first[own] - np.cumsum([0, *sizes])[:-1]  # places among all words
        hard, found = worst[~toxic[own]], worst[toxic[own]]
        heavy = best[~toxic[own]] + 0.02
        heavy /= heavy.sum()
        for step in range(word_steps):
            adam.rate = 0.01 * (1 - 0.95 * (turn * word_steps + step) / (rounds * word_steps))
            own = np.concatenate([rng.choice(starts, 64), rng.choice(hard, 96, p=heavy), rng.choice(found, 96)])
            ids = words[own + np.arange(WINDOW)[:, None]]
            x = np.concatenate([vectors[ids], p["E"][row[ids]]], axis=2)
            keep: dict = {}
            _, logit = net.forward(p, net.project(p, x, "f"), net.project(p, x, "b"), None, keep)
            grads, dxf, dxb = net.backward(p, keep, ((net._sigmoid(logit) - target) / len(target)).astype(np.float32))
            dx = net.input_gradients(p, grads, x, dxf, dxb)
            grads["E"] = np.zeros_like(p["E"])
            np.add.at(grads["E"], row[ids].ravel(), dx[:, :, 2 * CHAR_HIDDEN:].reshape(-1, WORD_INPUT))
            grads["E"][0] = 0
            adam.step(grads)
    model.known, model.inputs = _Numbers(), model.inputs[:0]
    return model


#: pieces of a training text that is longer than the bound
PIECES = 64


def _bounded(text: Column, max_chars: int) -> Column:
    """A whole text, or pieces from places all over a longer one that make up ``max_chars`` characters."""
    size = max(1, max_chars // PIECES)
    places = F.sequence(F.lit(0), F.lit(PIECES - 1))
    room = F.length(text) - F.lit(size)
    pieces = F.transform(places, lambda i: F.substring(text, F.floor(room * i / (PIECES - 1)).cast("int") + 1, F.lit(size)))
    return F.when(F.length(text) <= max_chars, text).otherwise(F.array_join(pieces, " "))


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int) -> list[tuple[str, int]]:
    """(text, label) of a bounded sample of the labelled rows that may be learnt from."""
    fit = labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isNotNull() & (remainder_of_id(labels["doc_id"], 3) != 1))
    fit = fit.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    order = F.xxhash64("doc_id")
    some = fit.where("label = 1").orderBy(order, "doc_id").limit(max_toxic).unionByName(fit.where("label = 0").orderBy(order, "doc_id").limit(max_clean))
    chosen = docs.join(F.broadcast(some), "doc_id").where("text is not null")  # at most max_toxic + max_clean rows
    return [(r["text"], r["label"]) for r in chosen.select("doc_id", _bounded(F.col("text"), max_chars).alias("text"), "label").distinct().orderBy("doc_id", "text").limit(max_toxic + max_clean).collect()]


def _trained(docs: DataFrame, labels: DataFrame, max_toxic: int, max_clean: int, max_chars: int) -> Model | None:
    """A model of the labelled rows that may be learnt from; the driver then holds no more than the model."""
    give_back()
    rows = training_rows(docs, labels, max_toxic, max_clean, max_chars)
    texts, marks = [t for t, _ in rows], [y for _, y in rows]
    del rows
    model = train(texts, marks)
    del texts, marks
    give_back()
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_toxic: int = 1200, max_clean: int = 4800, max_chars: int = 200_000) -> DataFrame:
    """doc_id, score, a row per row."""
    docs = id_and_text(docs, id_col, text_col)
    return apply_model(docs, _trained(docs, labels, max_toxic, max_clean, max_chars))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_toxic: int = 1200, max_clean: int = 4800, max_chars: int = 200_000) -> DataFrame:
    """Rows of ``docs``, all columns, that score under ``threshold``, by a model of their own labelled rows."""
    shared = docs.sparkSession.sparkContext.broadcast(_parts(_trained(id_and_text(docs), labels, max_toxic, max_clean, max_chars)))

    def judge():
        held = _model_of(shared)
        return lambda texts: [True] * len(texts) if held is None else held.score(texts) < threshold

    return keep_rows(docs, judge)


def _parts(model: Model | None):
    return None if model is None else (model.chars, model.words, model.vocabulary)


def _model_of(shared) -> Model | None:
    """The task's model: built once for each broadcast in a worker, so that its memory of words lasts."""
    parts = shared.value
    return None if parts is None else held(("toxicity", shared.__dict__.get("_path")), lambda: Model(*parts))


def apply_model(docs: DataFrame, model: Model | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(_parts(model))  # weights and at most 20,000 words
    schema = docs.select("doc_id", F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _model_of(shared)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                scores = np.zeros(batch.num_rows) if held is None else held.score(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores.astype(np.float64))], ["doc_id", "score"])

    return map_arrow(docs, run, schema)
