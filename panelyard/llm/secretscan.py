"""Secret scans by assignment-aware lexing.

A text is read as source or configuration: a name (bare, quoted, or the last key in brackets), an optional type, one of
``= : := =>`` and an expression: quoted strings, names and unquoted values, joined by ``+``. Each pair binds its name to
the literals of its expression, so a name used later stands for the literals it was given (constants are propagated, in
the order of the text, also through ``${name}``). The words of the target name give its sensitivity, length, entropy and
character classes the literal's strength; a product of ``THRESHOLD`` or more marks every literal that went into the value,
wherever it stands.

Beside these ``literal`` spans there are three plain kinds by pattern: assign, access and hex. All matching is linear in
the text, and texts without a sensitive word are not lexed.

Defined cases: null and empty texts have no spans; offsets are code points; values computed from constants are followed
up to ``FOLLOWED`` characters (a literal as such is judged whole, whatever its length); a span that several targets mark
is one; repeated rows get the same answer; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.common import id_and_text, map_arrow

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD, FOLLOWED = 0.5, 1024
# fixed values: patterns and least lengths of the plain kinds, as the contract has them
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: sensitivity of the words of a name; pairs of neighbouring words count as one word too
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0,
    "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "authkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "masterkey": 0.9, "bearer": 0.9, "auth": 0.7,
}
#: words that say a name holds something about a secret, not the secret
ABOUT = frozenset("name names id file path url uri type length size count policy field label prompt hint message error expiry hash regex pattern".split())
PLACEHOLDER = re.compile(r"(?:change|replace|your|example|sample|dummy|placeholder|insert|todo|redacted|test)[-_ ]?|<.*>$|(.)\1*$", re.ASCII | re.IGNORECASE)
_STEMS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer")

_PAIR = re.compile(
    r"""(?<![\w.\-])(?P<q>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=q)\]?[ \t]*+
    (?: :[ \t]*+[A-Za-z_][A-Za-z0-9_.\[\]]*+[ \t]*+=(?![=>]) | := | => | =(?![=>~]) | :(?![:/=]) )[ \t]*+""",
    re.VERBOSE | re.ASCII,
)
_TERM = re.compile(
    r"""[bBrRuUfF]{0,2}(?: "(?P<double>(?:[^"\\\n]|\\.)*+)" | '(?P<single>(?:[^'\\\n]|\\.)*+)' )
    | \$\{(?P<ref>[A-Za-z_][A-Za-z0-9_.\-]*+)\} | (?P<bare>[^\s"'`,;(){}\[\]<>+]++)(?P<call>\()?""",
    re.VERBOSE | re.ASCII,
)
_PLUS = re.compile(r"[ \t]*+\+[ \t]*+")
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

Piece = tuple[str, int, int, bool]  # text, start, end, whether it was quoted


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns: matches without overlap from the left, too short ones dropped."""
    spans = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            spans.append((m.start(), 0, m.end()))
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        least = LEAST[KINDS[kind]]
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end() - m.start() >= least]
    return spans


def sensitivity(name: str) -> float:
    """How likely a variable of this name holds a secret: its most sensitive word, less if it is about one only."""
    words = [w.lower() for w in _CAMEL.findall(name)]
    known = [SENSITIVE.get(w, 0.0) for w in [*words, *(a + b for a, b in zip(words, words[1:], strict=False))]]
    return max(known, default=0.0) * (0.3 if words and words[-1] in ABOUT else 1.0)


def strength(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret rather than like a word, a placeholder or a sentence."""
    n = len(value)
    if n < 8 or PLACEHOLDER.match(value):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for _, c in sorted(Counter(value).items()))
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    return min(1.0, bits / 3) * (1.0 if mixed else 0.6) * (1.0 if quoted or mixed else 0.5) * (0.3 if any(c.isspace() for c in value) else 1.0)


def pairs(text: str) -> Iterator[tuple[str, list[Piece]]]:
    """Names with the literals of their values, constants replaced by what they stand for."""
    known: dict[str, list[Piece]] = {}
    at = 0
    while m := _PAIR.search(text, at):
        pieces, at, lone, terms = [], m.end(), None, 0
        while t := _TERM.match(text, at):
            terms += 1
            kind = t.lastgroup
            if kind in ("double", "single"):
                pieces.append((t[kind], t.start(kind), t.end(kind), True))
            elif kind == "ref":
                pieces += known.get(t["ref"], [])
            elif kind == "bare":
                lone = t.start()
                pieces += known.get(t["bare"]) or [(t["bare"], t.start(), t.end(), False)]
            at = t.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()
        pieces = [p for p in pieces if p[0]]
        if terms > 1 and sum(len(p[0]) for p in pieces) > FOLLOWED:
            known.pop(m["name"], None)
        else:
            known[m["name"]] = pieces
        yield m["name"], pieces
        if lone is not None and terms == 1:
            at = lone  # the value may be the name of a pair of its own


def literal_spans(text: str) -> set[tuple[int, int, int]]:
    """(start, kind, end) of literals that reach a sensitive name."""
    low = text.lower()
    if not any(s in low for s in _STEMS):
        return set()
    found = set()
    for name, pieces in pairs(text):
        s = sensitivity(name)
        if s and pieces and s * strength("".join(p[0] for p in pieces), any(p[3] for p in pieces)) >= THRESHOLD:
            found |= {(start, 3, end) for _, start, end, _ in pieces}
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (kind, start, end) by start, then kind in the order of KINDS, then end; a row per row."""
    docs = id_and_text(docs, id_col, text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text"):
                text = t.as_py() or ""
                spans = sorted([*plain_spans(text), *literal_spans(text)])
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    schema = docs.selectExpr("doc_id", "cast(array() as array<struct<kind:string,start:bigint,`end`:bigint>>) spans").schema
    return map_arrow(docs, run, schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def summary(scanned: DataFrame) -> DataFrame:
    """One flat row per document: counts of the plain kinds, the digest of their spans, and all spans."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return scanned.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
