"""Field comparators: two values of a field give STRUCT<class, code, score, blocks>.

`score` is a share of the policy's weight. A value that is missing on either side gives missing_both,
missing_left or missing_right and no score, never a SQL null. What a comparator reads out of a value
(`read`: both sides') can be given, so that it is found once for a record and not for each of its pairs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import names, phone, text
from ..functions.policy import Policy

TYPE = "struct<class:string,code:string,score:double,blocks:boolean>"


def result(klass: str, code: str, share: float, p: Policy, blocks: bool = False) -> Column:
    """One outcome; scores are rounded to four places as weights and shares are given."""
    return F.struct(F.lit(klass).alias("class"), F.lit(code).alias("code"), F.lit(round(p.weight * share, 4)).alias("score"), F.lit(blocks).alias("blocks"))


def with_missing(a: Column, b: Column, p: Policy, outcome: Column) -> Column:
    gone = lambda c: c.isNull() | (F.trim(c) == "")
    return (
        F.when(gone(a) & gone(b), result("missing_both", f"{p.name}_missing_both", 0, p))
        .when(gone(a), result("missing_left", f"{p.name}_missing_left", 0, p))
        .when(gone(b), result("missing_right", f"{p.name}_missing_right", 0, p))
        .otherwise(outcome)
    )


def plain(c: Column) -> Column:
    return F.lower(text.squeeze(c))


Read = tuple[Column, Column] | None


def exact(a: Column, b: Column, p: Policy, read: Read = None) -> Column:
    """Equal after case and blanks (`plain`), or a conflict that blocks if the policy says so."""
    x, y = read or (plain(a), plain(b))
    return with_missing(a, b, p, F.when(x == y, result("exact_match", f"{p.name}_exact", 1, p)).otherwise(result("conflict", f"{p.name}_mismatch", 0, p, p.blocks)))


def age(a: Column, b: Column, p: Policy, both_exact: Column | None = None, read: Read = None) -> Column:
    """By years of difference. A strong conflict blocks only where both ages are exact. Reads `text.age`."""
    x, y = read or (text.age(a), text.age(b))
    gap = F.abs(x - y)
    hard = result("strong_conflict", "age_strong_conflict", 0, p, True)
    if both_exact is not None:
        hard = F.when(both_exact, hard).otherwise(result("conflict", "age_conflict_inexact", 0, p))
    return with_missing(
        a, b, p,
        F.when(x.isNull() | y.isNull(), result("insufficient", "age_unparsable", 0, p))
        .when(gap == 0, result("exact_match", "age_exact", 1, p))
        .when(gap <= 1, result("normalized_match", "age_within_1", 0.8, p))
        .when(gap <= 3, result("compatible", "age_within_3", 0.4, p))
        .when(gap < 5, result("conflict", "age_conflict", 0, p))
        .otherwise(hard),
    )


def date(a: Column, b: Column, p: Policy, read: Read = None) -> Column:
    """Partial dates agree as far as both go; a part that differs blocks. Reads `text.date_parts`."""
    if read:
        return with_missing(a, b, p, _date(*read, p))
    parts = F.struct(text.date_parts(a).alias("x"), text.date_parts(b).alias("y"))
    return with_missing(a, b, p, text.let(parts, lambda t: _date(t["x"], t["y"], p)))


def _date(x: Column, y: Column, p: Policy) -> Column:
    block = lambda part: result("strong_conflict", f"date_{part}_conflict", 0, p, True)
    have = lambda part: x[part].isNotNull() & y[part].isNotNull()
    return (
        F.when(~have("y"), result("insufficient", "date_unparsable", 0, p))
        .when(x["y"] != y["y"], block("year"))
        .when(have("m") & (x["m"] != y["m"]), block("month"))
        .when(have("m") & have("d") & (x["d"] != y["d"]), block("day"))
        .when(have("m") & have("d"), result("exact_match", "date_exact", 1, p))
        .when(have("m"), result("normalized_match", "date_year_month", 0.8, p))
        .otherwise(result("compatible", "date_year_only", 0.3, p))
    )


# Class and share of weight of each phone outcome.
PHONE = {
    "exact_match": ("exact_match", 1.0), "intl_prefix_equivalent": ("exact_match", 1.0), "compatible_local_intl": ("compatible", 0.6),
    "ocr_assisted_compatible": ("compatible", 0.6), "weak_suffix_overlap": ("partial_match", 0.4), "conflict": ("conflict", 0.0), "insufficient": ("insufficient", 0.0),
}


def phones(a: Column, b: Column, p: Policy, parsed_a: Column, parsed_b: Column, repaired: Column | None = None) -> Column:
    """By the outcome of two parsed numbers; never blocks."""
    outcome = phone.outcome(parsed_a, parsed_b, repaired)
    out = result("insufficient", "phone_insufficient", 0, p)
    for name, (klass, share) in PHONE.items():
        out = F.when(outcome == name, result(klass, f"phone_{name}", share, p)).otherwise(out)
    return with_missing(a, b, p, out)


def email(a: Column, b: Column, p: Policy) -> Column:
    x, y = text.valid_email(a), text.valid_email(b)
    return with_missing(a, b, p, F.when(x.isNull() | y.isNull(), result("insufficient", "email_invalid", 0, p)).when(x == y, result("exact_match", "email_exact", 1, p)).otherwise(result("conflict", "email_mismatch", 0, p)))


def overlap(a: Column, b: Column, p: Policy, read: Read = None) -> Column:
    """Token sets: none in common conflicts, Jaccard of 0.6 is compatible, less is partial. Reads `text.tokens`."""
    x, y = read or (text.tokens(a), text.tokens(b))
    shared, union = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return with_missing(a, b, p, F.when(shared == 0, result("conflict", "no_overlap", 0, p)).when(5 * shared >= 3 * union, result("compatible", "high_overlap", 1, p)).otherwise(result("partial_match", "some_overlap", 0.4, p)))


def place(a: Column, b: Column, p: Policy, read: Read = None, tokens: Read = None) -> Column:
    """Equal, or a token in common. Reads `plain` and `text.tokens`."""
    (x, y), (s, t) = read or (plain(a), plain(b)), tokens or (text.tokens(a), text.tokens(b))
    return with_missing(
        a, b, p,
        F.when(x == y, result("exact_match", "same_place", 1, p)).when(F.arrays_overlap(s, t), result("partial_match", "place_overlap", 0.3, p)).otherwise(result("conflict", "different_place", 0, p)),
    )


def time_window(a: Column, b: Column, p: Policy, read: Read = None) -> Column:
    """The right one may be later, or at most 30 minutes earlier; so the order of the two matters. Reads `text.clock_minutes`."""
    x, y = read or (text.clock_minutes(a), text.clock_minutes(b))
    return with_missing(a, b, p, F.when(x.isNull() | y.isNull(), result("insufficient", "time_unparsable", 0, p)).when((y >= x) | (F.abs(y - x) <= 30), result("compatible", "time_plausible", 1, p)).otherwise(result("conflict", "time_implausible", 0, p)))


def name(a: Column, b: Column, p: Policy, channel: Column, left_is_short: Column) -> Column:
    """By the channel of two represented names. A short left name counts 0.4 at most and is compatible at best."""
    out = result("missing_both", f"{p.name}_missing_both", 0, p)
    for key, (klass, share) in names.CHANNELS.items():
        full = result(klass, f"name_{key}", share, p)
        if share > 0 and key != "initials_match":
            full = F.when(left_is_short, result("compatible", "name_short_name_match", min(share, 0.4), p)).otherwise(full)
        out = F.when(channel == key, full).otherwise(out)
    return with_missing(a, b, p, out)


def compared(field: str, reliability: str, outcome: Column) -> Column:
    """An outcome with the field's name and reliability, as decisions take it."""
    return F.struct(F.lit(field).alias("field"), F.lit(reliability).alias("reliability"), outcome["class"].alias("class"), outcome["code"].alias("code"), outcome["score"].alias("score"), outcome["blocks"].alias("blocks"))


def total_score(comparisons: Column) -> Column:
    """Sum of the positive scores in policy order; a fold, so that the double is the same in every plan."""
    return F.aggregate(comparisons, F.lit(0.0), lambda acc, c: acc + F.when(c["score"] > 0, c["score"]).otherwise(0.0))
