"""Names across scripts: representations by an Arrow function, and the comparison cascade as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Consonants of Arabic letters, named once; presentation forms are led back to them by NFKC.
ARABIC_LETTERS = {
    "ء": "'", "آ": "A", "أ": "A", "ؤ": "W", "إ": "A", "ئ": "Y", "ا": "A", "ب": "B", "ة": "H", "ت": "T", "ث": "TH", "ج": "J",
    "ح": "H", "خ": "KH", "د": "D", "ذ": "DH", "ر": "R", "ز": "Z", "س": "S", "ش": "SH", "ص": "S", "ض": "D", "ط": "T", "ظ": "Z",
    "ع": "'", "غ": "GH", "ف": "F", "ق": "Q", "ك": "K", "ل": "L", "م": "M", "ن": "N", "ه": "H", "و": "W", "ى": "Y", "ي": "Y",
    "پ": "P", "چ": "CH", "ژ": "ZH", "ک": "K", "گ": "G",
}
# Transliteration of Cyrillic and Greek letters (lower case; capitals follow by their first letter).
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k",
    "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts",
    "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "-", "ы": "y", "ь": "-", "э": "e", "ю": "yu", "я": "ya", "є": "ye", "і": "i", "ї": "yi",
    "ґ": "g", "ј": "j", "љ": "lj", "њ": "nj", "џ": "dzh",
}
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps",
    "ω": "o",
}
VARIANTS = {
    "muhammad": ("mohammad", "mohammed", "muhammed", "mohamed", "mohamad", "mohd"),
    "yusuf": ("youssef", "yousef", "yusef", "youseff"),
    "ali": ("aly",),
    "hasan": ("hassan", "hassen"),
    "husayn": ("hussain", "hussein", "husein"),
    "abdullah": ("abdallah", "abdul"),
    "ahmad": ("ahmed", "ahmet"),
    "ibrahim": ("ebraheem",),
}
SPACED_VARIANTS = {"abdel lah": "abdullah", "abdul lah": "abdullah"}
HONORIFICS = set("mr mrs ms miss dr prof sir madam haji hajjah alhaji hajiya sheikh sheikha syed sayyid sayyida ustaadh ustadha hafiz hafiza".split())
ARTICLES = set("al el bin bint ibn abu um umm".split())
_VARIANT = {v: k for k, vs in VARIANTS.items() for v in (k, *vs)} | SPACED_VARIANTS
_RANGES = (("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))), ("cyrillic", ((0x400, 0x52F),)), ("greek", ((0x370, 0x3FF),)))

_TEXT = ("unicode", "script", "latin", "plain_latin", "skeleton", "initials")
SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("words", T.IntegerType()), T.StructField("is_short", T.BooleanType()), T.StructField("is_formal", T.BooleanType())]
)


def plain_unicode(value: str) -> str:
    """Compatibility-decomposed, without combining marks and punctuation, lower-cased, blanks squeezed."""
    kept = "".join(ch for ch in unicodedata.normalize("NFKD", value) if not unicodedata.combining(ch))
    return " ".join(re.sub(r"[^\w\s]", " ", kept.lower()).split())


def script_of(text: str) -> str:
    if not text.strip():
        return "unknown"
    found = set()
    for ch in text:
        for name, spans in _RANGES:
            if any(lo <= ord(ch) <= hi for lo, hi in spans):
                found.add(name)
                break
        else:
            if ch.isalpha():
                found.add("latin" if ord(ch.lower()[0]) < 128 else "unknown")
    return "latin" if not found else found.pop() if len(found) == 1 else "mixed"


def arabic_skeleton(text: str) -> str:
    out = []
    for ch in text:
        if 0x64B <= ord(ch) <= 0x652:
            continue
        if ch in "  ":
            out.append(" ")
        elif ch.isalpha():
            base = ch if ch in ARABIC_LETTERS else unicodedata.normalize("NFKC", ch)
            out.append("".join(ARABIC_LETTERS.get(x, x) for x in base))
    return "".join(out).strip()


def spelt(text: str, table: dict[str, str]) -> str:
    out = []
    for ch in text:
        to = table.get(ch.lower())
        out.append(ch if to is None else "" if to == "-" else to.capitalize() if ch != ch.lower() else to)
    return "".join(out)


def consonants(text: str) -> str:
    letters = [ch for ch in text.upper() if ch.isalpha() and ch not in "AEIOU"]
    return "".join(ch for k, ch in enumerate(letters) if k == 0 or letters[k - 1] != ch)


def plain_latin(text: str) -> str:
    return " ".join(t for t in re.findall("[a-z0-9]+", text.lower()) if t not in HONORIFICS and t not in ARTICLES)


def represent_one(raw: str | None) -> dict:
    if not raw or not raw.strip():
        return {"unicode": "", "script": "unknown", "latin": "", "plain_latin": "", "skeleton": "", "tokens": [], "initials": "", "words": 0, "is_short": False, "is_formal": False}
    unicode = plain_unicode(raw)
    script = script_of(unicode)
    latin = unicode
    if script == "arabic":
        latin = arabic_skeleton(raw).lower()
    elif script in ("cyrillic", "greek"):
        latin = spelt(raw, CYRILLIC if script == "cyrillic" else GREEK)
    skeleton = arabic_skeleton(raw) if script == "arabic" else consonants(latin)
    plain = plain_latin(latin)
    known = _VARIANT.get(plain, plain)  # the whole name is looked up, not its parts
    tokens = re.findall("[a-z0-9]+", known)
    words = len(raw.split())
    short = words <= 1 or not tokens or (words == 2 and len(tokens[0]) <= 2)
    return {"unicode": unicode, "script": script, "latin": known, "plain_latin": plain, "skeleton": skeleton, "tokens": tokens, "initials": "".join(t[0] for t in tokens), "words": words, "is_short": short, "is_formal": script in ("cyrillic", "greek")}


@F.pandas_udf(SCHEMA)
def represent(s: pd.Series) -> pd.DataFrame:
    """STRUCT of a name's forms; computed once for each record, not for each pair."""
    return pd.DataFrame([represent_one(x) for x in s], columns=SCHEMA.names)


def ratio(a: str, b: str) -> float:
    """200 * LCS / (length a + length b), by rows of the LCS table."""
    if not a and not b:
        return 100.0
    other = np.frombuffer(b.encode("utf-32-le"), dtype=np.uint32)
    row = np.zeros(len(other) + 1, dtype=np.int64)
    for ch in a:
        hit = np.where(other == ord(ch), row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(hit, row[1:]))
    return 200.0 * float(row[-1]) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """`ratio` over Arrow batches, for texts of any length."""
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)])


def channel(a: Column, b: Column, unicode_ratio: Column, latin_ratio: Column, skeleton_ratio: Column, threshold: float = 72.0) -> Column:
    """The first channel by which two represented names agree, from their three ratios (columns, so no Python runs inside)."""
    cross = a["script"] != b["script"]
    both = lambda f: (a[f] != "") & (b[f] != "")
    jaccard = F.size(F.array_intersect(a["tokens"], b["tokens"])) / F.size(F.array_union(a["tokens"], b["tokens"]))
    has_tokens = (F.size(a["tokens"]) > 0) & (F.size(b["tokens"]) > 0)
    reordered = (F.array_sort(F.array_distinct(a["tokens"])) == F.array_sort(F.array_distinct(b["tokens"]))) & (a["tokens"] != b["tokens"])
    return (
        F.when((a["unicode"] == "") | (b["unicode"] == ""), "missing")
        .when(~cross & (a["unicode"] == b["unicode"]), "exact_original")
        .when(~cross & (unicode_ratio >= 95), "normalized_original")
        .when(both("latin") & (a["latin"] == b["latin"]) & (a["plain_latin"] != b["plain_latin"]), "known_variant_match")
        .when(both("latin") & (latin_ratio >= 90), F.when(cross & (a["is_formal"] | b["is_formal"]), "formal_transliteration_match").otherwise("normalized_original"))
        .when(cross & both("skeleton") & (skeleton_ratio >= 72), "consonant_skeleton_compatible")
        .when(has_tokens & (jaccard >= 0.6), F.when(reordered, "token_reordered_compatible").otherwise("token_set_compatible"))
        .when(a["is_short"] & b["is_short"] & (a["initials"] == b["initials"]) & (F.length(a["initials"]) >= 2), "initials_match")
        .when(both("latin") & (latin_ratio >= threshold), F.when(cross, "formal_transliteration_match").otherwise("normalized_original"))
        .when(both("latin") & (latin_ratio >= 45), "ambiguous")
        .otherwise("mismatch")
    )


# Class and share of the field's weight of each channel.
CHANNELS = {
    "exact_original": ("normalized_match", 1.0), "normalized_original": ("normalized_match", 1.0), "known_variant_match": ("compatible", 0.75),
    "formal_transliteration_match": ("compatible", 0.85), "consonant_skeleton_compatible": ("compatible", 0.6), "token_reordered_compatible": ("compatible", 0.5),
    "token_set_compatible": ("compatible", 0.5), "initials_match": ("partial_match", 0.25), "ambiguous": ("compatible", 0.5), "mismatch": ("conflict", 0.0),
}
