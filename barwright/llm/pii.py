"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Base kinds (email, ip, card, phone) are reported whenever pattern and validator agree; their score only says how
much the surroundings support them.  Added kinds (iban, ssn, local_phone) are weaker proposals: an IBAN must pass
mod 97, the others need a context word to reach the threshold, and none may overlap a base span.  All patterns
run in time linear in the text.

Spans are code points, the end exclusive, leftmost and non-overlapping per kind.  Nulls: a null text is empty; a
null doc_id is kept.  Repeated rows are scanned each for itself, an empty table gives an empty result, extra
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import texts

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "ssn")
BASE = KINDS[:4]
THRESHOLD = 0.6
CONTEXT_CHARS = 40

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?(?:[ .-][0-9]{2,4}){1,4}(?![0-9])")
DIGIT = re.compile("[0-9]")

#: kind -> score without context, words that raise it, words that lower it.  Fixed values.
CONTEXT = {
    "email": (0.9, ("mail", "contact", "kontakt", "correo"), ()),
    "ip": (0.7, ("ip", "host", "server", "address", "adresse"), ("version", "release", "section")),
    "card": (0.8, ("card", "visa", "credit", "karte", "carte", "tarjeta"), ("isbn", "order", "serial")),
    "phone": (0.8, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"), ()),
    "iban": (0.8, ("iban", "account", "bank", "konto", "compte", "cuenta"), ()),
    "local_phone": (0.3, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"), ("isbn", "version")),
    "ssn": (0.4, ("ssn", "social security"), ("isbn", "order", "serial")),
}


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled; the digit sums add up to a multiple of ten."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """The local part is the run left of an @, at most back to the previous match."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_PART:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", at + 1)
    return found


def small_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose pattern and validator agree."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(map(small_number, m[0].split("."))):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                yield "phone", *m.span()
    for m in IBAN.finditer(text):
        if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
            yield "iban", *m.span()
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "ssn", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(digits_of(m[0])) <= 15:
            yield "local_phone", *m.span()


def has_word(words: tuple[str, ...], around: str) -> bool:
    return any(re.search(rf"\b{re.escape(w)}", around) for w in words)


def score(kind: str, text: str, start: int, end: int) -> float:
    value, raising, lowering = CONTEXT[kind]
    around = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS // 2]}".lower()
    return round(min(1.0, max(0.0, value + 0.4 * has_word(raising, around) - 0.4 * has_word(lowering, around))), 2)


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Confirmed spans with their scores, by start and then kind."""
    found = [(k, a, b, score(k, text, a, b)) for k, a, b in propose(text)]
    base = [s for s in found if s[0] in BASE]
    taken = list(base)
    for s in sorted((s for s in found if s[0] not in BASE and s[3] >= threshold), key=lambda s: (-s[3], s[1], KINDS.index(s[0]))):
        if all(s[2] <= t[1] or t[2] <= s[1] for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each span (of overlapping ones the first) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, threshold: float = THRESHOLD, clean: bool = False) -> DataFrame:
    """doc_id and ``spans`` (kind, start, end, score) per row; with ``clean`` the redacted text as ``clean_text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            rows = b.column("text").to_pylist()
            spans = [spans_of(t, threshold) for t in rows]
            out = {"doc_id": b.column("doc_id"), "spans": pa.array(
                [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in ss] for ss in spans], kind)}
            if clean:
                out["clean_text"] = pa.array([redact(t, s) for t, s in zip(rows, spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>"
    return texts(docs).mapInArrow(run, schema + ", clean_text string" * clean)


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and the spans as text."""
    joined = "concat_ws(',', transform({}, s -> concat_ws(':', s.kind, s.start, s.end)))"
    base = f"filter(spans, s -> s.kind IN {BASE!r})"
    return found.select(
        "doc_id", *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))
