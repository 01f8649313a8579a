"""Personal data: regular expressions propose spans, checksums confirm them,
words nearby adjust the score.

Base spans (e-mail and IP addresses, card and phone numbers) follow the fixed
patterns and checks and always stay. The operator adds IBANs that pass mod 97
and US social security numbers whose surroundings speak for them. Every
pattern runs in time linear in the text: those that could try a long run of
characters again from each of its places are anchored to the run's start.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import row_key, slices, text_or_empty

#: Fixed: the kinds of base spans in the order in which ties are listed; then the added ones.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Characters before and after a span in which context words count.
NEAR = 48
#: Added kinds need this score.
LEAST = 0.5
#: Score of a confirmed span without any context, and words that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.6, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "mail e-mail email contact kontakt correo courriel write",
    "ip": "ip address host server adresse login",
    "card": "card visa mastercard amex credit debit karte carte tarjeta cvv payment",
    "phone": "phone tel call mobile fax cell telefon téléphone teléfono whatsapp",
    "iban": "iban account bank konto compte cuenta bic swift transfer",
    "ssn": "ssn social security tax taxpayer sozialversicherung",
}
RAISE, LOWER = 0.3, 0.2
#: Words that speak against personal data.
AGAINST = frozenset("version example sample test order invoice isbn sku".split())

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:[\x20-]?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_CONTEXT = {k: frozenset(v.split()) for k, v in CONTEXT.items()}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _iban_end(found: str) -> int:
    """Where the IBAN ends that ``found`` begins with, 0 for none: upper-case
    words may follow it, so every end before white space or at the last
    character is tried, the longest first, and of one length between 15 and
    34 characters the remainder decides."""
    ends = [len(found), *[i for i in range(len(found) - 1, 0, -1) if found[i] in " -"]]
    for end in ends:
        iban = re.sub("[ -]", "", found[:end])
        if 15 <= len(iban) <= 34 and mod97(iban):
            return end
    return 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What ``local@domain`` matches from left to right: an address begins
    where the run of local characters before its @ does."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            low = domain.end()
            yield start, low
        at = text.find("@", domain.end() if domain else at + 1)


def _in_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their checks confirm; a match that fails is dropped and the
    search goes on behind it."""
    if "@" in text:
        for s, e in _emails(text):
            yield "email", s, e
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_in_255, m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(m[0])
        at = m.start() + end if end else m.end()
        if end:
            yield "iban", m.start(), at
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", m.start(), m.end()


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for part in (text[max(0, start - NEAR):start], text[end:end + NEAR]) for w in _WORD.findall(part)}
    score = PRIOR[kind] + RAISE * bool(near & _CONTEXT[kind]) - LOWER * bool(near & AGAINST)
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind as listed; base spans whatever
    their score, added ones from ``LEAST`` on. Offsets count code points, the
    end is exclusive; spans of different kinds may overlap."""
    spans = [Span(k, s, e, _score(text, k, s, e)) for k, s, e in _proposed(text)]
    return sorted((x for x in spans if x.kind in BASE or x.score >= LEAST), key=lambda x: (x.start, KINDS.index(x.kind)))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind."""
    out, end = [], 0
    for s in spans:
        if s.start >= end:
            out += [text[end:s.start], f"[{s.kind.upper()}]"]
        end = max(end, s.end)
    return "".join([*out, text[end:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def find_personal_data(docs: DataFrame, with_redacted: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored):
    doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, found (array
    of kind, start, end, score), row_key and, with ``with_redacted``, the
    redacted text. Null texts count as empty and have no spans; the hash of
    no spans is that of the empty string. An empty table gives none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            found = [find(t) for t in texts]
            base = [[s for s in x if s.kind in BASE] for x in found]
            columns = {"doc_id": b.column("doc_id")}
            for k in BASE:
                columns[f"n_{k}"] = pa.array([sum(s.kind == k for s in x) for x in base], pa.int64())
            columns |= {
                "base_sha256": pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in base], pa.string()),
                "spans": pa.array([listed(x) for x in found], pa.string()),
                "found": pa.array([[s._asdict() for s in x] for x in found], pa.list_(_SPAN)),
                "row_key": b.column("row_key")}
            if with_redacted:
                columns["redacted"] = pa.array([redact(t, x) for t, x in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"),
                       text_or_empty().alias("text"))
    schema = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
              "found array<struct<kind:string,start:bigint,end:bigint,score:double>>, row_key long")
    return rows.mapInArrow(run, schema + (", redacted string" if with_redacted else ""))
