"""Operator 6: personal data by patterns, checksums and context words.

Patterns propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges and digit
counts for the rest), and words near a span raise or lower its score. Spans of the base kinds (email, ip, card,
phone) that pass their validator always stay; spans of the added kinds stay from ``KEEP`` on.

Positions are code points, ends exclusive. Defined cases: a null or empty text has no spans; every row
is judged for itself, so repeated rows repeat their results; an empty table gives none; other columns
are ignored by the query and kept by ``mask``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import document_columns, small_arrow_batches
from skerry.sources.tables import read_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits are taken whole, which finds what a plain scan finds, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
NOT_DIGIT = re.compile(r"[^0-9]")

#: Words nearby that make a kind likelier, in the languages of the corpus, or less likely; scores.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "courriel", "correo", "kontakt"),
    "ip": ("ip", "address", "server", "host", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = {
    "email": ("noreply",),
    "ip": ("version", "release", "chapter"),
    "card": ("isbn", "tracking", "serial"),
    "phone": ("isbn", "version", "serial"),
    "iban": ("sample", "specimen"),
    "ssn": ("isbn", "part", "serial", "version"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
NEAR, GAIN, LOSS, KEEP = 40, 0.3, 0.3, 0.5
_FOR, _AGAINST = ({k: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, v))})(?!\w)") for k, v in words.items()} for words in (CONTEXT, AGAINST))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def small_parts(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in ip.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the mail pattern, found from their @ signs, so long words cost one look."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def spans(text: str) -> list[tuple[int, str, int, float]]:
    """All spans as (start, kind, end, score), by start, then kind as listed."""
    found = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), "phone", m.end()))
    found += [(m.start(), "iban", m.end()) for m in IBAN.finditer(text) if 15 <= len(x := m[0].replace(" ", "")) <= 34 and mod_97(x)]
    found += [(m.start(), "ssn", m.end()) for m in SSN.finditer(text)]
    out = []
    for a, kind, b in found:
        around = text[max(0, a - NEAR) : a].lower() + " " + text[b : b + NEAR].lower()
        near, other = _FOR[kind].search(around) is not None, _AGAINST[kind].search(around) is not None
        score = min(1.0, max(0.0, PRIOR[kind] + GAIN * near - LOSS * other))
        if kind in BASE or score >= KEEP:
            out.append((a, kind, b, score))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def joined(found: list[tuple[int, str, int, float]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b, _ in found)


def masked(text: str) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    out, end = [], 0
    for a, kind, b, _ in spans(text):
        if a >= end:
            out += [text[end:a], f"<{kind.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` to its spans: counts of the base kinds, a digest of them, and all spans with scores."""
    small_arrow_batches(docs.sparkSession)
    names = [f"n_{k}" for k in BASE]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                found = spans(text.as_py())
                base = [s for s in found if s[1] in BASE]
                for i, k in enumerate(BASE):
                    cols[i].append(sum(s[1] == k for s in base))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(found))
                cols[6].append([s[3] for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t.type) for c, t in zip(cols, list(schema)[1:], strict=True))], schema=schema)

    return document_columns(docs).mapInArrow(scan, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_sha256 string, spans string, scores array<double>")


def mask(docs: DataFrame) -> DataFrame:
    """The documents with masked texts; n_chars follows the text. Null texts stay null."""
    small_arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else masked(t) for t in (x.as_py() for x in batch.column(at))]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(scan, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents"))
