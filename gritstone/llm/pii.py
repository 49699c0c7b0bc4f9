"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

All patterns run in time linear in the text: runs are entered only at their start and are matched
possessively, which leaves the leftmost non-overlapping matches as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_or_null, mapped

#: The kinds of the contract, in its order, then the detector's own.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
_RANK = {k: n for n, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api[_-]?key)[ \t]*+[=:][ \t]*+[\"']?([A-Za-z0-9/+_.-]{16,}+)")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")

#: Words near a span that make a kind more or less likely.
CONTEXT = {
    "email": ({"email", "mail", "contact", "write"}, {"example"}),
    "ip": ({"ip", "host", "server", "address"}, {"version", "release", "section"}),
    "card": ({"card", "visa", "mastercard", "credit", "payment"}, {"order", "tracking", "isbn"}),
    "phone": ({"phone", "call", "tel", "mobile", "fax"}, {"version", "ratio"}),
    "iban": ({"iban", "account", "bank"}, set()),
    "secret": ({"token", "secret", "key", "password"}, {"sample", "placeholder"}),
    "ssn": ({"ssn", "social", "security"}, {"part", "serial"}),
}
#: What a kind scores before its context: checksummed kinds start high.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.95, "secret": 0.6, "ssn": 0.4}
BASE_KINDS = KINDS[:4]
#: The detector's own spans count from this score on.
LEAST = 0.5
_NEAR = 48


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    if not 15 <= len(text) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, least, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        end = None
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        # A start before this sign cannot reach a later one: the sign is not a local character.
        least = end if end is not None else at + 1
        at = text.find("@", least)
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract's spans, by start and then kind as listed."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _digits(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], _RANK[x[0]]))


def _own_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("iban", m.start(), m.end()) for m in _IBAN.finditer(text) if mod97(m[0])]
    if "=" in text or ":" in text:
        out += [("secret", m.start(1), m.end(1)) for m in _SECRET.finditer(text)]
    if "-" in text:
        for m in _SSN.finditer(text):
            area, group, serial = m[0].split("-")
            if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
                out.append(("ssn", m.start(), m.end()))
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - _NEAR) : start])} | {w.lower() for w in _WORD.findall(text[end : end + _NEAR])}
    good, bad = CONTEXT[kind]
    return round(min(1.0, max(0.0, PRIOR[kind] + 0.2 * bool(near & good) - 0.3 * bool(near & bad))), 3)


def detect(text: str | None) -> list[Span]:
    """All spans by start, then kind: every base span whatever its score, own spans from LEAST on."""
    text = text or ""
    spans = [Span(k, a, b, _score(text, k, a, b)) for k, a, b in base_spans(text)]
    spans += [s for k, a, b in _own_spans(text) if (s := Span(k, a, b, _score(text, k, a, b))).score >= LEAST]
    return sorted(spans, key=lambda s: (s.start, _RANK[s.kind], s.end))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _joined(spans) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code
    points, end exclusive), found (the spans with their scores).

    Null texts are empty: no spans and the hash of nothing. Whole texts are searched, however long, in time linear
    in them. Repeated rows stay; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    source = docs.select(column_or_null(docs, id_col, "bigint").alias("doc_id"), column_or_null(docs, text_col, "string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE_KINDS}
            digest, spans, found = [], [], []
            for text in batch.column(1):
                all_spans = detect(text.as_py())
                base = [s for s in all_spans if s.kind in BASE_KINDS]
                for k in BASE_KINDS:
                    counts[k].append(sum(s.kind == k for s in base))
                digest.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(all_spans))
                found.append([{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in all_spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(found, kind)],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "found"],
            )

    return mapped(
        source, run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,score:double>>"
    )


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with all found spans replaced by ``<KIND>`` and the length column, where there is one,
    set anew from it. Null texts stay null; all other columns, whatever their names, pass through unread; an
    empty table stays empty."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redact(t, detect(t)) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = mapped(docs, run, docs.schema)
    if length_col in docs.columns:
        kind = docs.schema[length_col].dataType
        out = out.withColumn(length_col, F.when(F.col(text_col).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
