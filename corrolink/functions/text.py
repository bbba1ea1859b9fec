"""Text normalisation and parsing as Column expressions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digit systems, directional controls, punctuation.
ARABIC_INDIC = "٠١٢٣٤٥٦٧٨٩"
EASTERN_INDIC = "۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "0123456789"
BIDI_CONTROLS = "‎‏‪‫‬‭‮⁦⁧⁨⁩"
ARABIC_PUNCTUATION, ASCII_PUNCTUATION = "،؛؟", ",;?"

# The field that a label at the start of a line names, in the order in which labels are tried.
ARABIC_LABELS = (
    ("الاسم", "name"), ("اسم", "name"), ("الاسم الكامل", "name"),
    ("العمر", "age"), ("عمر", "age"), ("السن", "age"),
    ("تاريخ الميلاد", "date_of_birth"), ("تاريخ الولادة", "date_of_birth"),
    ("هاتف", "phone"), ("الهاتف", "phone"), ("جوال", "phone"), ("رقم الهاتف", "phone"),
    ("البريد الإلكتروني", "email"), ("بريد إلكتروني", "email"), ("إيميل", "email"),
    ("العنوان", "home_address"), ("عنوان", "home_address"),
    ("الموقع", "last_known_location"), ("مكان", "last_known_location"), ("آخر مكان", "last_known_location"), ("آخر موقع", "last_known_location"),
    ("رقم الهوية", "government_id"), ("الهوية", "government_id"), ("بطاقة", "government_id"),
    ("الأم", "family_member_names"), ("الأب", "family_member_names"), ("الأقارب", "family_member_names"),
)


def let(value: Column, fn) -> Column:
    """fn(value), where value is computed once however often fn names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def normalize_digits(c: Column) -> Column:
    """Arabic-Indic digits of both systems as ASCII digits."""
    return F.translate(c, ARABIC_INDIC + EASTERN_INDIC, ASCII_DIGITS * 2)


def digit_systems(c: Column) -> Column:
    """Names of the digit systems in a text, in a fixed order."""
    found = [("ascii", ASCII_DIGITS), ("arabic_indic", ARABIC_INDIC), ("eastern_arabic_indic", EASTERN_INDIC)]
    return F.array_compact(F.array(*[F.when(c.rlike(f"[{digits}]"), F.lit(name)) for name, digits in found]))


def strip_bidi(c: Column) -> Column:
    return F.translate(c, BIDI_CONTROLS, "")


def bidi_count(c: Column) -> Column:
    return F.length(c) - F.length(strip_bidi(c))


def arabic_punctuation(c: Column) -> Column:
    return F.translate(c, ARABIC_PUNCTUATION, ASCII_PUNCTUATION)


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_for_parsing(c: Column) -> Column:
    return squeeze(arabic_punctuation(strip_bidi(c)))


def arabic_label(c: Column) -> Column:
    """The field that the text's first label names; the first label in the list that fits."""
    working = F.trim(F.lower(clean_for_parsing(c)))
    out = F.lit(None).cast("string")
    for label, field in reversed(ARABIC_LABELS):
        out = F.when(working.startswith(label), F.lit(field)).otherwise(out)
    return out


def arabic_label_pattern() -> str:
    """All labels as one alternation, longest first."""
    return "|".join(sorted((label for label, _ in ARABIC_LABELS), key=len, reverse=True))


def tokens(c: Column) -> Column:
    """Different runs of ASCII letters and digits, lower-cased, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(c), r"(?U)[\s]+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def age(c: Column) -> Column:
    """The first whole number of one to three digits."""
    found = F.regexp_extract(normalize_digits(c), r"(?<![0-9A-Za-z_])([0-9]{1,3})(?![0-9A-Za-z_])", 1)
    return F.when(found != "", found.cast("int"))


def date_parts(c: Column) -> Column:
    """Year, month and day of an ISO date that may end after the year or the month; all null for other texts."""
    whole = r"^([0-9]{4})(?:-([0-9]{2})(?:-([0-9]{2}))?)?$"
    t = F.trim(c)
    part = lambda i: F.when(t.rlike(whole), F.nullif(F.regexp_extract(t, whole, i), F.lit("")).cast("int"))
    return F.struct(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))


def clock_minutes(c: Column) -> Column:
    """Minutes of the first clock time, with or without a.m. or p.m."""
    pattern = r"(?i)\b(\d{1,2}):(\d{2})\s*(a\.?m\.?|p\.?m\.?)?"
    hour, minute = F.regexp_extract(c, pattern, 1).cast("int"), F.regexp_extract(c, pattern, 2).cast("int")
    half = F.replace(F.lower(F.regexp_extract(c, pattern, 3)), F.lit("."), F.lit(""))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.when(c.rlike(pattern), hour * 60 + minute)


def valid_email(c: Column) -> Column:
    """Comparison form of a complete address; null if it is not one. Sentence punctuation behind it goes."""
    e = F.lower(F.regexp_replace(F.trim(c), "[.,;:]+$", ""))
    local, domain = F.split_part(e, F.lit("@"), F.lit(1)), F.split_part(e, F.lit("@"), F.lit(2))
    labels = F.split(domain, r"\.")
    whole = (
        (F.length(e) - F.length(F.replace(e, F.lit("@"), F.lit(""))) == 1)
        & (F.length(e) <= 254)
        & local.rlike(r"^(?U)[^\s@]+$")
        & ~local.rlike(r"^\.|\.$|\.\.")
        & (F.size(labels) >= 2)
        & F.forall(labels, lambda x: (F.length(x) <= 63) & x.rlike(r"^(?U)[^\s.@-](?:[^\s.@]*[^\s.@-])?$"))
        & (F.length(F.element_at(labels, -1)) >= 2)
    )
    return F.when(whole, e)


def consonant_skeleton(c: Column) -> Column:
    """Upper-case letters without vowels, runs of one letter drawn together."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), r"[^\p{L}]|[AEIOU]", ""), r"(.)\1+", "$1")


def phonetic_prefix(c: Column) -> Column:
    """The first three different consonants; null with fewer than two."""
    letters = F.array_distinct(F.split(F.regexp_replace(F.upper(c), r"[^\p{L}]|[AEIOU]", ""), ""))
    letters = F.filter(letters, lambda x: x != "")
    return F.when(F.size(letters) >= 2, F.array_join(F.slice(letters, 1, 3), ""))


def indel_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (length a + length b), by a fold over the rows of the LCS table; 100 for two empty texts.

    For short texts such as names; `names.indel_ratio` has the Arrow version for long ones.
    """
    xs, ys = F.split(a, ""), F.split(b, "")
    start = F.array_repeat(F.lit(0), F.length(b).cast("int") + 1)

    def next_row(row: Column, ch: Column) -> Column:
        steps = F.sequence(F.lit(1), F.length(b))
        cell = lambda acc, j: F.array_append(
            acc, F.when(F.element_at(ys, j.cast("int")) == ch, F.element_at(row, j.cast("int")) + 1).otherwise(F.greatest(F.element_at(acc, -1), F.element_at(row, j.cast("int") + 1)))
        )
        return F.aggregate(steps, F.array(F.lit(0)), cell)

    total = F.length(a) + F.length(b)
    lcs = F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(xs, start, next_row), -1))
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs / total)


# Language that a release may not hold.
FORBIDDEN_PHRASES = ("confirmed_match", "identity_confirmed", "person_found", "guaranteed_match", "definitely_same_person", "successfully_reunited", "99_percent_match")
WITHHELD = "[PROHIBITED RELEASE LANGUAGE WITHHELD]"


def normalized_output(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_")


def has_forbidden_language(c: Column) -> Column:
    text = normalized_output(c)
    out = F.lit(False)
    for phrase in FORBIDDEN_PHRASES:
        out = out | text.contains(phrase)
    return out


def sanitize_forbidden(c: Column, marker: str = WITHHELD) -> Column:
    for phrase in FORBIDDEN_PHRASES:
        c = F.regexp_replace(c, "(?i)" + r"[\W_]+".join(phrase.split("_")), marker)
    return c
