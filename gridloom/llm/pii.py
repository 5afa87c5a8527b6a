"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

Every pattern reads a text in linear time: a match can only begin where a run of its
characters begins, so each is anchored there or scanned from its rare character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import id_and_text, row_slices

#: In the order in which kinds of equal start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
#: Words that raise or lower a kind's score within ``CONTEXT`` characters before or behind a span.
CONTEXT = 40
RAISE = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "address", "client"), "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "bank", "transfer"), "ssn": ("ssn", "social", "security"),
}
LOWER = {"email": ("example", "noreply"), "ip": ("version", "section", "release"), "card": ("order", "isbn", "serial"), "phone": ("isbn", "version"), "iban": (), "ssn": ("part", "serial", "order")}
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
_WORD = re.compile(r"[a-z]+")
_DIGITS = str.maketrans("", "", " -().+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The IBAN check: the rearranged code as a number leaves 1 modulo 97."""
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        if at >= last:
            start = at
            while start > last and (text[start - 1] in "._%+-" or text[start - 1].isascii() and text[start - 1].isalnum()):
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                yield start, domain.end()
                last = domain.end()
        at = text.find("@", at + 1)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end (code points, end exclusive) and score of all confirmed spans, by start, then kind."""
    found = [("email", *s) for s in _emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 12 <= len(d := m.group().translate(_DIGITS)) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(m.group().translate(_DIGITS)) <= 15]
    found += [("iban", *m.span()) for m in IBAN.finditer(text) if mod97(m.group())]
    found += [("ssn", *m.span()) for m in SSN.finditer(text)]
    out = []
    for kind, start, end in found:
        near = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower())) | set(_WORD.findall(text[end : end + CONTEXT].lower()))
        score = BASE_SCORE[kind] + 0.3 * any(w in near for w in RAISE[kind]) - 0.3 * any(w in near for w in LOWER[kind])
        score = round(min(1.0, max(0.05, score)), 2)
        if kind != "ssn" or score >= 0.5:  # has no checksum: only with a context word
            out.append((kind, start, end, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def pii_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and spans, an array of kind, start, end, score, of each row.

    Base kinds: leftmost non-overlapping matches per kind of email, ip (parts to 255), card (12 to 19
    digits, Luhn) and phone (9 to 15 digits); failing matches are dropped, a null text is empty.  Added: iban (mod 97) and ssn
    (only near a context word).  Texts without any give an empty array.  Spans of equal start are ordered by kind.
    Texts of any length are read whole; equal rows give equal rows, ids may be null or repeat; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for piece in row_slices(batch):
                found = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t)] for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(found, shape)], ["doc_id", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    out = id_and_text(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:double>>")
    return out.withColumnRenamed("doc_id", id_col)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span's characters replaced by its mark; of overlapping spans the first counts."""
    out, at = [], 0
    for start, end, mark in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
            at = end
    return "".join(out) + text[at:]
