"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their scores.

Contract of the cases at the edge: a null text counts as empty and has no spans; a null doc_id is
kept as it is; repeated rows are judged one by one; other columns of the input are not looked at.
Every scan is linear in the length of the text, also for one very long token.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

#: Kinds in the order of the digest; those after the fourth are what the method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")

# What each kind's context words are, how far they count, how a span is scored.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address", "login", "from"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "account", "bank", "transfer", "konto"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
CONTEXT_GAIN = 0.35
CONTEXT_CHARS = 40
ACCEPT_ADDED = 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[A-Za-z-]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(ch, 36)) for ch in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each at sign outwards: the part before it is the longest run that no earlier match took."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        # a second dotted part is needed; possessive runs cannot miss one, since the runs hold no dot
        if m:
            out.append((start, m.end()))
            done = m.end()
        elif start == at:
            done = max(done, at)
        else:
            done = at + 1  # the run before this sign cannot begin a later match
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]


def ibans(text: str) -> list[tuple[int, int]]:
    """Longest prefix of a candidate that passes mod-97."""
    out = []
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            out.append(m.span())
            continue
        end = m.end()
        while (end := text.rfind(" ", m.start(), end)) - m.start() >= 15:
            if mod97(text[m.start() : end].replace(" ", "")):
                out.append((m.start(), end))
                break
    return out


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": lambda t: [m.span() for m in _SSN.finditer(t)]}


def find(text: str) -> list[Span]:
    """All spans of a text, by kind as listed, then start. The four base kinds always stay; added kinds need ACCEPT_ADDED after context."""
    out = []
    has_digit = re.search("[0-9]", text) is not None
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text or kind != "email" and not has_digit:
            continue
        for start, end in FINDERS[kind](text):
            near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start])} | {w.lower() for w in _WORD.findall(text[end : end + CONTEXT_CHARS])}
            score = min(1.0, BASE_SCORE[kind] + CONTEXT_GAIN * any(w in near for w in CONTEXT[kind]))
            if kind in KINDS[:4] or score >= ACCEPT_ADDED:
                out.append(Span(kind, start, end, score))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """Put [KIND] for each span; where spans overlap, the one that starts first (then the longer) covers the rest."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]]) if out else text


def _digest_text(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, its spans with scores, and the text with the spans replaced."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        ts = common.texts(batch, "t")
        spans = [find(t) for t in ts]
        return {
            "id": batch.column("id"),
            "spans": [[s._asdict() for s in row] for row in spans],
            "redacted": [redact(t, row) if row else t for t, row in zip(ts, spans, strict=True)],
        }

    return common.mapped(docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as t"), run, f"id {kind}, spans array<struct<kind:string,start:int,end:int,score:double>>, redacted string")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of each document, from the spans that `find` gives."""
    common.small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> dict:
        rows = [find(t) for t in common.texts(batch, "t")]
        counts = {k: [sum(s.kind == k for s in row) for row in rows] for k in KINDS}
        return {
            "doc_id": batch.column("id"),
            **{f"n_{k}": counts[k] for k in KINDS},
            "base_sha256": [hashlib.sha256(_digest_text([s for s in row if s.kind in KINDS[:4]]).encode()).hexdigest() for row in rows],
            "spans": [_digest_text(row) for row in rows],
            "top_score": [max((s.score for s in row), default=0.0) for row in rows],
        }

    return common.mapped(
        docs.selectExpr("doc_id as id", "text as t"),
        run,
        "doc_id bigint, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string, top_score double",
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(common.table(spark, sf_dir, "documents"))


def redact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with personal data replaced, n_chars counted anew; rows and other columns stay."""
    common.small_batches(spark)
    fields = docs.schema

    def run(batch: pa.RecordBatch) -> dict:
        ts = batch.column("text").to_pylist()
        new = [t and redact(t, find(t)) for t in ts]
        return {f.name: batch.column(f.name) for f in fields} | {"text": new, "n_chars": [None if t is None else len(t) for t in new]}

    return common.mapped(docs, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
