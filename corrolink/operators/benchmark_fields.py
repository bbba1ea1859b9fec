"""The benchmark's own reading of a record: nine keys and a mark, tolerant of misread digits; looser than `extract`, and without spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phone, text

# Words that begin no name; the comma form and the plain form of a name.
NO_NAME = (
    "email", "phone", "tel", "contact", "dob", "date", "id", "age", "aged",
    "approximately", "approx", "about", "estimated", "scar", "mark",
    "shelter", "gate", "school", "clinic", "hospital", "road", "market",
)
COMMA_NAME = re.compile(
    r"([؀-ۿ\w]+(?:\s+[؀-ۿ\w]+)?),\s*"
    r"([A-Z؀-ۿ][a-z؀-ۿ]{2,}(?:\s+[A-Z؀-ۿ][a-z؀-ۿ]{2,})?)"
)
PLAIN_NAME = re.compile(r"(?i)(?:name\s*[:.]?\s*)?([؀-ۿ\w]+(?:\s+[؀-ۿ\w]+){0,3})")
# Of each key its patterns in the order in which they are tried, and the group that is its value.
PHONE_LABEL = f"(?:phone|tel|contact|{text.arabic_label_pattern()})"
PATTERNS = {
    "age": (
        (r"(?i)(?:age|aged|عمر|العمر)\s*[:.]?\s*(\d{1,3}(?:\s*[-–]\s*\d{1,3})?)", 1),
        (r"(?i)(?:approximately|approx\.?|about|estimated)\s+(\d{1,3})", 1),
        (r"(?i)(\d{1,3}(?:\s*[-–]\s*\d{1,3})?)\s*(?:years?|ans?|عاما)", 1),
        (r"(?i)(?:age|aged|yr|yrs|yo)\s*[:.]?\s*([l1]\d|\d{1,2})\b", 1),
    ),
    "date_of_birth": ((r"(?i)(?:DOB|date of birth)\s*[:.]?\s*([l\d]{4}(?:[-–][l\d]{2}(?:[-–][l\d]{2})?)?)", 1),),
    "government_id": ((r"(?i)(?:ID|identification|registration)\s*[:.#]?\s*([A-Z]{2,4}[\-–]\d{4,8})", 1),),
    "phone": (
        (rf"(?i){PHONE_LABEL}\s*[:.]?\s*([+l]?[\dl\s()\-.]{{7,20}})", 1),
        (rf"(?i)[,;]?\s*{PHONE_LABEL}?\s*([(]?[+l]?[\dl\s()\-.]{{7,20}})", 1),
        (r"\b([+l]?[\dl\s()\-.]{10,20})\b", 1),
    ),
    "email": ((r"(?i)(?:email|e-mail)\s*[:.]?\s*([\w.+-]+@[\w-]+\.[\w.]+)", 1),),
    "last_known_location": (
        (r"(?i)(?:at|near|seen at|located at|arrived at|shelter|taken to|admitted to)\s+([A-Z][\w\s]{3,40}?)(?:\.|,|$|;|\s+\d)", 1),
        (r"([A-Z][\w\s]+?(?:School|Gate|Market|Road|Clinic|Shelter|Depot|Station))", 1),
    ),
    "distinguishing_marks": ((r"(?i)(?:scar|tattoo|mark|limp|distinctive)\s+(?:above |on |near )?[\w\s]+?(?:eyebrow|hand|arm|leg|face|cheek|forehead)", 0),),
    "family_member_names": ((r"(?i)(?:mother|father|parent|sibling)\s+([\w\s]{2,30}?)(?:\.|,|$)", 1),),
}


class Rule(NamedTuple):
    tries: list[tuple[re.Pattern, int]]
    ascii_digits: bool  # whether digits of other scripts are read as ASCII digits
    clean: Callable[[str], str]


_CLEAN = {
    "age": lambda v: re.sub(r"\s*[-–]\s*", "-", v).replace("l", "1"),
    "date_of_birth": lambda v: v.replace("–", "-").replace("l", "1"),
    "government_id": lambda v: v.replace("–", "-"),
    "phone": lambda v: v,
    "email": lambda v: v.strip().lower(),
}
RULES = {key: Rule([(re.compile(p), group) for p, group in tries], key in ("age", "phone"), _CLEAN.get(key, str.strip)) for key, tries in PATTERNS.items()}
_DIGITS = str.maketrans(text.ARABIC_INDIC + text.EASTERN_INDIC, text.ASCII_DIGITS * 2)


def _number(words: str) -> bool:
    return any(ch.isdigit() for ch in words)


def _turned_round(raw: str) -> str | None:
    """`Given Family` of the first `Family, Given`, unless either half is a field."""
    m = COMMA_NAME.search(raw)
    if not m or any(_number(half) or half.split()[0].lower() in NO_NAME for half in m.groups()):
        return None
    return f"{m[2]} {m[1]}".strip()


def _plain_name(raw: str) -> str | None:
    m = PLAIN_NAME.search(raw)
    value = m[1].strip().rstrip(",") if m else ""
    return value if len(value) > 1 and not _number(value) else None


def name_of(raw: str) -> str | None:
    value = _turned_round(raw) or _plain_name(raw)
    return value if value and not value.lower().startswith(NO_NAME) else None


def fields_of(raw: str) -> list[tuple[str, str, str]]:
    """(key, value, certainty) of what a text holds; a phone is not yet held to be a number that can be dialled."""
    ascii_text, low = raw.translate(_DIGITS), raw.lower()
    name = name_of(raw)
    out = [("name", name, "exact")] if name else []
    for key, rule in RULES.items():
        said = ascii_text if rule.ascii_digits else raw
        hit = next((m[group] for pattern, group in rule.tries if (m := pattern.search(said))), None)
        if hit is None or (key == "date_of_birth" and not re.search(r"\d{4}", rule.clean(hit))):
            continue
        value = rule.clean(hit)
        hedged = key == "age" and ("-" in value or "approximately" in low or "estimated" in low)
        out.append((key, value, "estimated" if hedged else "exact"))
    return out


def extracted(records: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, value, certainty): what the benchmark reads from each text; null and empty texts hold nothing, phones must be valid once misread letters are mended."""
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *f) for i, t in zip(b["id"], b["t"], strict=True) for f in fields_of(t or "")]
            yield pd.DataFrame(rows, columns=["id", "key", "value", "certainty"])

    found = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInPandas(run, f"id {kind}, key string, value string, certainty string")
    dialled = text.let(phone.parse(phone.ocr_repair("value")), lambda p: p["is_valid"])
    return found.where((F.col("key") != "phone") | dialled)


def record(rows: DataFrame) -> DataFrame:
    """A raw record as the benchmark builds it: what is missing gets its default, the text is taken as safe, fields as an array.

    rows: record_id, source_type, language, text, display_name.
    """
    fields = extracted(rows, "record_id", "text").groupBy(F.col("id").alias("record_id")).agg(F.array_sort(F.collect_list(F.struct("key", "value", "certainty"))).alias("fields"))
    none = F.array().cast("array<struct<key:string,value:string,certainty:string>>")
    filled = rows.select(
        "record_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), F.coalesce("language", F.lit("English")).alias("language"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("text", F.lit("")).alias("safe_text"), F.coalesce("display_name", F.col("record_id").cast("string")).alias("display_name"),
    )
    return filled.join(fields, "record_id", "left").withColumn("fields", F.coalesce("fields", none))
