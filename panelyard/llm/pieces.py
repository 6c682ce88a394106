"""SentencePiece BPE by a merge-type prefix table, and decoding.

For each prefix of a text there is one last piece that its encoding ends in. It is found among the pieces that an
Aho-Corasick automaton matches at the prefix's end: the piece whose left neighbour, the last piece of the prefix before
it, is compatible with it, that is, the two encode to themselves when put together. The ids are then read backwards
from the end. Whether a pair is compatible, and whether a piece encodes to itself, is decided by merging the short
string itself by score, leftmost first, and remembered.

A text is cut before each word mark that follows another character, unless the vocabulary has a piece that spans such a
place; distinct words are encoded once per task. Characters without a piece become byte pieces.

Defined cases: null and empty texts give the end id only and decode to ''; repeated rows are encoded alike; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import held, id_and_text, map_arrow

MARK = "▁"
MINUS = float("-inf")
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: distinct words that a task remembers; beyond it the memory starts anew
REMEMBER = 200_000


class Pieces:
    """A BPE model with byte fallback, no normalisation and a leading word mark, read from a .model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.eos_bytes = array("i", [model.trainer_spec.eos_id]).tobytes()
        self.texts = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.spans_words = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.cuts_lines = not any("\n" in p for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.steps: dict[str, tuple[list[tuple[float, str, str]], bool]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.words: dict[str, bytes] = {}
        self.raw = [b"" if k in (CONTROL, UNKNOWN) else bytes([int(t[3:5], 16)]) if k == BYTE else t.replace(MARK, " ").encode() for t, k in zip(self.texts, self.kinds, strict=True)]

    def merges(self, piece: str) -> tuple[list[tuple[float, str, str]], bool]:
        """Merges of a short string in their order: score, then the first and the last symbol it leaves; and whether one symbol is left.

        The pair with the best score merges first, the leftmost of equals.
        """
        known = self.steps.get(piece)
        if known is None:
            parts, steps, score = list(piece), [], self.score.get
            scores = [score(a + b, MINUS) for a, b in zip(parts, parts[1:], strict=False)]
            while scores and (best := max(scores)) > MINUS:
                i = scores.index(best)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                del scores[i]
                if i < len(scores):
                    scores[i] = score(parts[i] + parts[i + 1], MINUS)
                if i:
                    scores[i - 1] = score(parts[i - 1] + parts[i], MINUS)
                steps.append((best, parts[0], parts[-1]))
            known = self.steps[piece] = (steps, len(parts) == 1)
        return known

    def compatible(self, left: str, right: str) -> bool:
        """Whether both stand for themselves side by side: no merge across the border comes before those that complete them."""
        (a, _), (b, alone) = self.merges(left), self.merges(right)
        if not alone:
            return False
        i = j = 0
        tail, head, score = left[-1], right[0], self.score.get
        while True:
            over = score(tail + head, MINUS)
            own, other = a[i][0] if i < len(a) else MINUS, b[j][0] if j < len(b) else MINUS
            if over > MINUS and over > own and over >= other:
                return False
            if own == MINUS and other == MINUS:
                return True
            if own >= other:  # the left one first if equal
                tail = a[i][2]
                i += 1
            else:
                head = b[j][1]
                j += 1

    def last_piece(self, text: str, end: int, ends: list[list[str]], last: list[str | None]) -> str:
        """Entry ``end`` of the prefix table: the last piece of the encoding of text[:end + 1]. Entries are filled as they are asked for."""
        known = last[end]
        if known is not None:
            return known
        for piece in ends[end]:
            before = end - len(piece)
            if before < 0:
                fits = self.merges(piece)[1]
            else:
                left = last[before] or self.last_piece(text, before, ends, last)
                right = self.pairs.get(left)
                if right is None:
                    right = self.pairs[left] = {}
                fits = right.get(piece)
                if fits is None:
                    fits = right[piece] = self.compatible(left, piece)
            if fits:
                last[end] = piece
                return piece
        last[end] = text[end]  # a character without a piece stands alone
        return text[end]

    def encode_word(self, text: str) -> bytes:
        """Ids of a text without cuts, as 32-bit integers: the prefix table, then ids from the last prefix backwards."""
        ends: list[list[str]] = [[] for _ in text]
        for end, piece in self.automaton.iter(text):
            ends[end].append(piece)
        last: list[str | None] = [None] * len(text)
        if len(text) > 100:  # in order, so that no entry asks for many others
            for end in range(len(text)):
                self.last_piece(text, end, ends, last)
        end, out = len(text) - 1, array("i")
        while end >= 0:
            piece = last[end] or self.last_piece(text, end, ends, last)
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            else:
                out.extend([self.byte_ids[b] for b in reversed(piece.encode())])
            end -= len(piece)
        out.reverse()
        return out.tobytes()

    def _words(self, text: str) -> list[str]:
        """The text with its leading mark, cut where no piece can span."""
        if self.spans_words:
            return [(MARK if self.prefix else "") + text.replace(" ", MARK)]
        words: list[str] = []
        for i, line in enumerate(text.split("\n") if self.cuts_lines else [text]):
            first = self.prefix and i == 0
            if i:
                words.append("\n")
            if "  " in line or MARK in line or (first and line.startswith(" ")):
                words += re.findall(f"{MARK}+[^{MARK}]*|[^{MARK}]+", (MARK if first else "") + line.replace(" ", MARK))
            elif line or first:
                head, *rest = line.split(" ")
                if head or first:
                    words.append(MARK + head if first else head)
                words += [MARK + w for w in rest]
        return words

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        """Ids of a whole text, with the end id."""
        parts, known = [], self.words
        for w in self._words(text) if text else ():
            ids = known.get(w)
            if ids is None:
                ids = self.encode_word(w)
                if len(w) <= 64:
                    if len(known) >= REMEMBER:
                        known.clear()
                    known[w] = ids
            parts.append(ids)
        if end:
            parts.append(self.eos_bytes)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: marks become spaces, the leading one goes, bytes that aren't UTF-8 become U+FFFD each."""
        raw, ids = self.raw, ids.tolist()
        joined = b"".join([raw[i] for i in ids])
        if self.prefix and joined.startswith(b" ") and self.texts[next(i for i in ids if raw[i])].startswith(MARK):
            joined = joined[1:]
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _replaced(joined)


def _replaced(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out.append(raw[at:at + bad.start].decode() + "�")
            at += bad.start + 1
    return "".join(out)


def load(path: str) -> Pieces:
    """The model of a worker."""
    return held(("pieces", path), lambda: Pieces(path))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded (from the ids), a row per row. The model's file is there on every executor."""
    docs = id_and_text(docs, id_col, text_col)
    schema = docs.select("doc_id", F.array().cast("array<int>").alias("ids"), F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds what a batch holds
                part = batch.slice(at, 500)
                ids = [pieces.encode(t.as_py()) for t in part.column("text")]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(i) for i in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, pa.array([pieces.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return map_arrow(docs, run, schema)


def digests(encoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows, and the columns of them to keep."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), *keep,
    )
