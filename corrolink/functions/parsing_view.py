"""A text as patterns should read it, with the way back to the places of the raw text; canonical JSON and its hash."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime, timezone
from decimal import Decimal
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import ARABIC_INDIC, ARABIC_PUNCTUATION, ASCII_DIGITS, ASCII_PUNCTUATION, BIDI_CONTROLS, EASTERN_INDIC

_SWAP = dict(zip(ARABIC_INDIC + EASTERN_INDIC + ARABIC_PUNCTUATION, ASCII_DIGITS * 2 + ASCII_PUNCTUATION, strict=True))


class View(NamedTuple):
    text: str
    starts: list[int]  # raw start of each character of text
    ends: list[int]  # raw end of each


def parsing_view(raw: str) -> View:
    """Directional controls gone, Arabic punctuation and digits as ASCII, white space runs as one blank."""
    text, starts, ends = [], [], []
    for i, ch in enumerate(raw):
        if ch in BIDI_CONTROLS:
            continue
        if ch.isspace():
            if text and text[-1] == " ":
                ends[-1] = i + 1
                continue
            ch = " "
        text.append(_SWAP.get(ch, ch))
        starts.append(i)
        ends.append(i + 1)
    return View("".join(text), starts, ends)


def map_span(view: View, start: int, end: int) -> tuple[int, int]:
    """Raw span of a span of the view; an empty one maps to an empty one."""
    if end <= start:
        at = view.starts[start] if start < len(view.starts) else (view.ends[-1] if view.ends else 0)
        return at, at
    return view.starts[start], view.ends[end - 1]


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType()))]))
def view(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parsing_view(x or "") for x in s], columns=["text", "starts", "ends"])


def _plain(value: Any) -> Any:
    if isinstance(value, float) and (value != value or value in (float("inf"), float("-inf"))):
        raise ValueError("no canonical form for a number that is not finite")
    if isinstance(value, Decimal):
        text = format(value, "f")
        return (text.rstrip("0").rstrip(".") or "0") if "." in text else text
    if isinstance(value, datetime):
        if value.tzinfo is None:
            raise ValueError("no canonical form for a time without zone")
        return value.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def canonical_json(value: Any) -> str:
    """Keys in order, no blanks, times in UTC with microseconds, decimals as plain text."""
    return json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_sha256(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@F.pandas_udf(T.StringType())
def canonical(s: pd.Series) -> pd.Series:
    """Canonical form of JSON texts."""
    return s.map(lambda x: canonical_json(json.loads(x, parse_float=float)), na_action="ignore")
