"""Language identification by cross-parsing: the language whose labelled text explains a text in the fewest phrases.

For each language a suffix automaton holds every substring of a sample of its labelled text. A text is parsed greedily
into phrases, each the longest run that occurs in the sample; the number of phrases, times the logarithm of the
sample's length (the cost of pointing at a place in it), over the text's length estimates the cross entropy. The
smallest wins. Texts are lower-cased, all that isn't a letter is one blank, and they are parsed in blocks of ``BLOCK``
characters, so that all blocks of a batch advance together, one character a step.

An automaton's moves lie in one array by row displacement: the moves of a state begin at its base, and a second array
says whose move a place is. So memory grows with the sample, not with the alphabet, and every letter of a language's
sample is a symbol of its own in that language's automaton; a letter it lacks ends the phrase.

The sample takes documents by a hash of the id, at most ``max_rows`` a language, ``row_chars`` characters of each, and
``max_chars`` in all; texts to identify are parsed whole. Rows of the sample beyond ``max_chars`` calibrate: how many
phrases a character their own language needs. ``keep_identified`` lets a text go if its best language needs more than
``LIMIT`` times the rate that all but 1 % of the calibrating blocks keep to, beyond an allowance of ``ALLOWANCE`` phrases.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; of equal languages the first by name
wins; rows without a language, an id or a text aren't learnt from; with nothing to learn from all are ``und``;
repeated rows get the same answer; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.common import held, id_and_text, keep_rows, map_arrow, remainder_of_id

UNKNOWN = "und"
BLOCK = 256
#: how many times the usual rate of phrases a text of a language may have, and phrases that are free
LIMIT, ALLOWANCE = 1.25, 8
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def normalise(text: str | None) -> str:
    """Lower-case words with one blank between; empty if there is no letter."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Moves of the suffix automaton, symbol -> state for each state; state 0 is the start."""
    size = 2 * len(symbols) + 2
    link, length = [-1] * size, [0] * size
    last, states = 0, 1
    rows: list[dict[int, int]] = [{} for _ in range(size)]
    for c in symbols:
        new, states = states, states + 1
        length[new] = length[last] + 1
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = rows[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin, states = states, states + 1
                rows[twin], length[twin], link[twin] = dict(rows[q]), length[p] + 1, link[q]
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return rows[:states]


@dataclass
class Moves:
    """Moves of an automaton by row displacement: that of state s by symbol c is at place base[s] + c if owner[place] == s."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    dead: int  # a state without moves

    @classmethod
    def of(cls, rows: list[dict[int, int]], alphabet: int) -> Moves:
        """States with most moves are placed first, each where all its symbols fall on free places; single moves fill the gaps."""
        edges = sum(map(len, rows))
        taken = bytearray(2 * edges + 2 * alphabet + 2)
        base = [0] * len(rows)
        low, sparse = alphabet, alphabet  # where single moves and others look first; what is dense below is left to single moves
        for s in sorted(range(len(rows)), key=lambda s: -len(rows[s])):
            if not rows[s]:
                continue
            symbols = sorted(rows[s])
            first, tries = symbols[0], 0
            at = taken.find(0, low if len(symbols) == 1 else sparse)
            while True:
                if at + alphabet >= len(taken):
                    taken.extend(bytes(len(taken)))
                if len(symbols) == 1 or not any([taken[at - first + c] for c in symbols]):
                    break
                at, tries = taken.find(0, at + 1), tries + 1
            if tries > 8:
                sparse = at
            base[s] = at - first
            for c in symbols:
                taken[at - first + c] = 1
            if len(symbols) == 1:
                low = at
        owner = np.full(len(taken) + alphabet, -1, np.int32)
        to = np.zeros(len(owner), np.int32)
        for s, row in enumerate(rows):
            for c, t in row.items():
                owner[base[s] + c], to[base[s] + c] = s, t
        used = int(np.flatnonzero(owner >= 0).max(initial=0)) + alphabet + 1
        return cls(np.array([*base, 0], np.int32), owner[:used].copy(), to[:used].copy(), len(rows))

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is no move."""
        place = self.base[state] + symbol
        return np.where(self.owner[place] == state, self.to[place], -1)


class Letters:
    """Symbols of one language: the blank is 0, letters of its sample count from 1, all others are the last, which has no move."""

    def __init__(self, sample: str) -> None:
        seen = np.unique(np.frombuffer(sample.replace(" ", "").encode("utf-32-le"), np.uint32))
        self.seen, self.count = seen, len(seen) + 2
        self.low = np.full(0x250, self.count - 1, np.int32)  # most texts by table
        near = seen[seen < 0x250]
        self.low[near] = np.arange(1, len(near) + 1)
        self.low[32] = 0

    def of(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes) or codes.max() < len(self.low):
            return self.low[codes]
        at = np.minimum(np.searchsorted(self.seen, codes), max(0, len(self.seen) - 1))
        known = self.seen[at] == codes if len(self.seen) else np.zeros(len(codes), bool)
        return np.where(codes == 32, 0, np.where(known, at + 1, self.count - 1)).astype(np.int32)


@dataclass
class Model:
    """Samples by language, with the rate of phrases that is usual for it; tables are built where they are used."""

    samples: dict[str, str]
    usual: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.languages = sorted(self.samples)
        self.letters = [Letters(self.samples[lang]) for lang in self.languages]
        self.moves = []
        for letters, lang in zip(self.letters, self.languages, strict=True):
            codes = np.frombuffer(self.samples[lang].encode("utf-32-le"), np.uint32)
            self.moves.append(Moves.of(automaton(letters.of(codes).tolist()), letters.count))
        self.cost = np.array([np.log2(max(2, len(self.samples[lang]))) for lang in self.languages])

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (texts, languages) and blocks (texts); texts are normalised and not empty. A block begins a phrase."""
        lengths = np.array([len(t) for t in texts])
        codes = np.frombuffer(" ".join(texts).encode("utf-32-le"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        blocks = -(-lengths // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        place = np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[of] + place * BLOCK
        size = np.minimum(BLOCK, lengths[of] - place * BLOCK)
        order = np.argsort(-size, kind="stable")  # lanes that are over are a tail that is cut off
        begin, size = begin[order], size[order]
        alive = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # lanes longer than each step
        total = np.zeros((len(texts), len(self.languages)))
        for k, (moves, letters) in enumerate(zip(self.moves, self.letters, strict=True)):
            symbols = letters.of(codes)
            phrases = np.ones(len(of), np.int64)
            state = np.zeros(len(of), np.int32)
            for step in range(int(size[0]) if len(size) else 0):
                n = alive[step]
                c = symbols[begin[:n] + step]
                to = moves.step(state[:n], c)
                over = np.flatnonzero(to < 0)
                if len(over):  # the phrase ends, the next begins with this character
                    if step:
                        phrases[over] += 1
                    again = moves.step(np.zeros(len(over), np.int32), c[over])
                    to[over] = np.where(again < 0, moves.dead, again)  # a letter that no phrase holds is one of its own
                state[:n] = to
            total[:, k] = np.bincount(of[order], phrases, len(texts))
        return total, blocks

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross entropy (texts, languages) in bits a character; texts are normalised and not empty."""
        return self.phrases(texts)[0] * self.cost / np.array([len(t) for t in texts])[:, None]

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Learn the usual rates: breaks between phrases a character that 99 % of the blocks of a language's texts keep to."""
        for k, lang in enumerate(self.languages):
            cut = [t[i:i + BLOCK] for t in texts.get(lang, []) for i in range(0, len(t), BLOCK) if len(t) - i >= BLOCK]
            if cut:
                self.usual[lang] = float(np.quantile((self.phrases(cut)[0][:, k] - 1) / BLOCK, 0.99))

    def belongs(self, texts: list[str | None]) -> list[bool]:
        """Whether a text has letters and reads like its best language; one without calibrating texts takes any text."""
        distinct = {t: normalise(t) for t in dict.fromkeys(texts)}
        some = [t for t, n in distinct.items() if n]
        answers: dict[str | None, bool] = {}
        if some:
            found, blocks = self.phrases([distinct[t] for t in some])
            length = np.array([len(distinct[t]) for t in some])
            best = (found * self.cost).argmin(1)
            rate = np.array([self.usual.get(lang, 1.0) for lang in self.languages])[best]
            fits = found[np.arange(len(some)), best] - blocks <= LIMIT * rate * length + ALLOWANCE
            answers = dict(zip(some, fits.tolist(), strict=True))
        return [answers.get(t, False) for t in texts]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: how much shorter the best parse is than the second, from 0 to 1."""
        distinct = {t: normalise(t) for t in dict.fromkeys(texts)}
        some = [t for t, n in distinct.items() if n]
        answers: dict[str | None, tuple[str, float]] = {}
        if some and self.languages:
            e = self.entropies([distinct[t] for t in some])
            best = e.argmin(1)
            low = e[np.arange(len(some)), best]
            e[np.arange(len(some)), best] = np.inf
            second = e.min(1)
            score = np.where(np.isfinite(second), 1 - low / np.where(np.isfinite(second), second, 1), 1.0)
            answers = {t: (self.languages[b], float(s)) for t, b, s in zip(some, best, np.clip(score, 0, 1), strict=True)}
        found = [answers.get(t, (UNKNOWN, 0.0)) for t in texts]
        return [f[0] for f in found], np.array([f[1] for f in found], np.float64)


def labelled_texts(
    docs: DataFrame, lang_col: str = "lang", max_rows: int = 400, row_chars: int = 1000, max_chars: int = 60_000, max_languages: int = 500
) -> tuple[dict[str, str], dict[str, list[str]]]:
    """Normalised text by language of rows that may be learnt from, bounded by the parameters: the samples, and the texts left over."""
    fit = docs.where(docs[lang_col].isNotNull() & docs["text"].isNotNull() & (remainder_of_id(docs["doc_id"], 4) != 2))
    fit = fit.select(docs[lang_col].cast("string").alias("lang"), "doc_id", F.xxhash64("doc_id").alias("h"), "text")
    counts = fit.groupBy("lang").agg(F.count("*").alias("rows")).limit(max_languages + 1).collect()
    languages = len(counts)
    if languages > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not languages:
        return {}, {}
    # hashes are even, so about three times max_rows lie under a limit known from the count, and only these are ranked
    limits = [(r["lang"], -(2**63) + min(2**64 - 1, 2**64 * 3 * max_rows // r["rows"])) for r in counts]
    near = fit.select("lang", "doc_id", "h").join(F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long")), "lang").where("h <= below")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.select("lang", "doc_id", "h").distinct().withColumn("rank", rank).where(F.col("rank") <= max_rows)
    texts = fit.join(F.broadcast(chosen.select("lang", "doc_id")), ["lang", "doc_id"]).select("lang", "h", "doc_id", F.substring("text", 1, row_chars).alias("text")).distinct()
    samples: dict[str, str] = {}
    left: dict[str, list[str]] = {}
    for r in texts.orderBy("lang", "h", "doc_id", "text").limit(max_rows * max(1, languages)).collect():
        held, more = samples.setdefault(r["lang"], ""), normalise(r["text"])
        if len(held) >= max_chars:
            left.setdefault(r["lang"], []).append(more)
        elif more and more not in held:
            samples[r["lang"]] = (held + " " + more)[:max_chars]
    return {k: v for k, v in samples.items() if v}, left


def sample(docs: DataFrame, lang_col: str = "lang", **bounds) -> dict[str, str]:
    """The samples of ``labelled_texts``."""
    return labelled_texts(docs, lang_col, **bounds)[0]


def _model(samples: tuple[tuple[str, str], ...], usual: tuple[tuple[str, float], ...] = ()) -> Model:
    """The model of these samples, built once in a worker."""
    return held(("language", samples, usual), lambda: Model(dict(samples), dict(usual)))


def identify(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, a row per row."""
    labelled = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(sorted(sample(labelled).items())))
    docs = id_and_text(docs, id_col, text_col)
    schema = docs.select("doc_id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(shared.value)
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                languages, scores = model.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs, run, schema)


def keep_identified(docs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs``, all columns, whose text reads like its best language (``Model.belongs``); with nothing to learn from, those with a letter."""
    labelled = docs.select("doc_id", "text", docs[lang_col].alias("lang"))
    samples, left = labelled_texts(labelled)
    model = Model(samples)
    model.calibrate(left)
    shared = docs.sparkSession.sparkContext.broadcast((tuple(sorted(samples.items())), tuple(sorted(model.usual.items()))))

    def judge():
        model = _model(*shared.value)
        if not model.languages:
            return lambda texts: [bool(normalise(t)) for t in texts]
        return model.belongs

    return keep_rows(docs, judge)
