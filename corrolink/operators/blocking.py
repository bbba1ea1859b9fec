"""Blocking: records that share a key under some rule become candidate pairs.

A rule gives a key column; keys are exploded into one narrow table, so that all rules need one shuffle
and one equi-join, never a comparison of all pairs. Caps spare pairs that a mandatory rule found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

# Rules whose pairs no cap may drop, and rules that two-hop expansion may follow.
MANDATORY = ("phone_full_exact", "email_exact", "government_id")
TWO_HOP = ("phone_full_exact", "email_exact", "government_id", "name_phonetic_plus_age", "family_member_plus_location")
TWO_HOP_RECORDS, TWO_HOP_EDGES, TWO_HOP_PAIRS = 20, (2, 60), 100
ALL_PAIRS_RECORDS = 8


def rules(name: Column, age: Column, location: Column, family: Column, government_id: Column, email: Column, phone: Column, ocr_phone: Column, repaired: Column) -> dict[str, Column]:
    """Key of each rule for a record; phone and ocr_phone are parsed structs. A null key means no pair by that rule."""
    first = lambda c: F.lower(F.element_at(F.split(F.trim(c), r"\s+"), 1))
    filled = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    given = lambda c, d: filled(c) & filled(d)
    digits, local = phone["digits"], F.when((phone["prefix"] != "none") & (phone["country_code"] != ""), phone["national_number"]).otherwise(phone["digits"])
    bucket = (F.floor(text.age(age) / 5) * 5).cast("string")
    skeleton = text.consonant_skeleton(name)
    return {
        "phone_full_exact": F.when(phone["is_valid"] & (F.length(digits) >= 9), F.concat(F.lit("full:"), digits)),
        "phone_local_international_compatible": F.when(phone["is_valid"] & (F.length(local) >= 7), F.concat(F.lit("compat:"), local)),
        "phone_ocr_compatible": F.when(repaired & ocr_phone["is_valid"] & (F.length(ocr_phone["digits"]) >= 9), F.concat(F.lit("ocr:"), ocr_phone["digits"])),
        "phone_suffix": F.when(F.length(ocr_phone["digits"]) >= 7, F.substring(ocr_phone["digits"], -7, 7)),
        "email_exact": text.valid_email(email),
        "government_id": F.when(F.length(government_id) > 0, government_id),
        "name_phonetic_plus_age": F.when(text.phonetic_prefix(name).isNotNull() & bucket.isNotNull(), F.concat_ws("|", text.phonetic_prefix(name), bucket)),
        "name_plus_location": F.when(given(name, location), F.concat_ws("|", first(name), F.lower(location))),
        "family_member_plus_location": F.when(given(family, location), F.concat_ws("|", first(family), F.lower(location))),
        "name_transliteration_skeleton": F.when(F.length(skeleton) >= 3, F.substring(skeleton, 1, 5)),
    }


def key_table(records: DataFrame, keys: dict[str, Column], scope: str, record: str, carry: list[str] | None = None) -> DataFrame:
    """(scope, record, rule, key, ...): one row for each key that a record has."""
    entries = F.array(*[F.struct(F.lit(rule).alias("rule"), key.cast("string").alias("key")) for rule, key in keys.items()])
    return records.select(F.col(scope).alias("scope"), F.col(record).alias("record"), *(carry or []), F.inline(entries)).where("key is not null")


def emissions(keys: DataFrame, pair_ok: Column | None = None) -> DataFrame:
    """(scope, a, b, rule): pairs a < b of records that share a rule's key. pair_ok may use columns a_x and b_x for carried x."""
    side = lambda s: keys.select("scope", "rule", "key", *[F.col(c).alias(f"{s}_{c}") for c in keys.columns if c not in ("scope", "rule", "key")])
    met = side("a").join(side("b"), ["scope", "rule", "key"]).where("a_record < b_record")
    if pair_ok is not None:
        met = met.where(pair_ok)
    return met.select("scope", F.col("a_record").alias("a"), F.col("b_record").alias("b"), "rule")


def intl_pair_ok() -> Column:
    """Guard of the compatible phone rules: two explicit international numbers must have equal digits."""
    compat = F.col("rule").isin("phone_local_international_compatible", "phone_ocr_compatible")
    return ~compat | ~(F.col("a_is_intl") & F.col("b_is_intl")) | (F.col("a_digits") == F.col("b_digits"))


def pairs(emitted: DataFrame) -> DataFrame:
    """(scope, a, b, rules): each pair once, with its rules in order."""
    return emitted.groupBy("scope", "a", "b").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def emission_stats(emitted: DataFrame) -> DataFrame:
    """Per rule: pairs emitted; over all: different pairs, duplicates, pairs of several rules."""
    per_rule = emitted.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    per_pair = emitted.groupBy("scope", "a", "b").agg(F.countDistinct("rule").alias("n_rules"), F.count(F.lit(1)).alias("n"))
    total = per_pair.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_pairs"), F.count(F.lit(1)).alias("unique_pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count_if(F.col("n_rules") > 1).alias("multi_rule")
    ).select(F.expr("stack(4, 'raw_pairs', raw_pairs, 'unique_pairs', unique_pairs, 'duplicates', duplicates, 'multi_rule', multi_rule) as (rule, n)"))
    return per_rule.unionByName(total)


def is_mandatory() -> Column:
    return F.arrays_overlap("rules", F.array(*[F.lit(r) for r in MANDATORY]))


def capped(candidates: DataFrame, cap: int) -> DataFrame:
    """Candidates in order of more rules, then ids; of those without a mandatory rule at most `cap` in a scope stay."""
    w = Window.partitionBy("scope", "mandatory").orderBy(F.desc(F.size("rules")), "a", "b")
    ranked = candidates.withColumn("mandatory", is_mandatory()).withColumn("place", F.row_number().over(w))
    kept = ranked.where(F.col("mandatory") | (F.col("place") <= cap))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy(F.desc(F.size("rules")), "a", "b"))).drop("place")


def recapped(ranked: DataFrame, limit: int) -> DataFrame:
    """Retrieval's second cap: pairs of one government id first, then the order they have; `limit` in all."""
    by_id = F.array_contains("rules", "government_id")
    w = Window.partitionBy("scope").orderBy(F.when(by_id, 0).otherwise(1), "rank")
    return ranked.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= limit)


def two_hop(found: DataFrame, scope_sizes: DataFrame) -> DataFrame:
    """Pairs a-c whose records share a neighbour b over meaningful rules, in scopes small enough; pairs found already are left out."""
    strong = found.where(F.arrays_overlap("rules", F.array(*[F.lit(r) for r in TWO_HOP])))
    edges = strong.join(scope_sizes.where(F.col("n_records") <= TWO_HOP_RECORDS).select("scope"), "scope", "left_semi")
    per = edges.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(*TWO_HOP_EDGES)).select("scope")
    edges = edges.join(per, "scope", "left_semi").select("scope", "a", "b")
    both = edges.unionByName(edges.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    hop = both.select("scope", F.col("a").alias("x"), F.col("b").alias("mid")).join(both.select("scope", F.col("a").alias("mid"), F.col("b").alias("y")), ["scope", "mid"]).where("x < y")
    fresh = hop.select("scope", F.col("x").alias("a"), F.col("y").alias("b"), "mid").join(found.select("scope", "a", "b"), ["scope", "a", "b"], "left_anti")
    grouped = fresh.groupBy("scope", "a", "b").agg(F.array_sort(F.collect_set("mid")).alias("via"))
    w = Window.partitionBy("scope").orderBy("a", "b")
    return grouped.withColumn("place", F.row_number().over(w)).where(F.col("place") <= TWO_HOP_PAIRS).drop("place")


def fallback_pairs(records: DataFrame, found: DataFrame, name: str = "name") -> DataFrame:
    """(scope, a, b, rule) for scopes without any pair: by the name's first token; where that finds none either, all pairs of at most eight records."""
    bare = records.join(found.select("scope").distinct(), "scope", "left_anti")
    first = bare.withColumn("key", F.lower(F.element_at(F.split(F.trim(name), r"\s+"), 1))).where(F.length("key") > 0)
    a, b = first.select("scope", "key", F.col("record").alias("a")), first.select("scope", "key", F.col("record").alias("b"))
    by_name = a.join(b, ["scope", "key"]).where("a < b").select("scope", "a", "b", F.lit("fallback_name").alias("rule"))
    small = bare.join(by_name.select("scope").distinct(), "scope", "left_anti")
    sized = small.join(small.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= ALL_PAIRS_RECORDS), "scope")
    every = sized.select("scope", F.col("record").alias("a")).join(sized.select("scope", F.col("record").alias("b")), "scope").where("a < b")
    return by_name.unionByName(every.select("scope", "a", "b", F.lit("fallback_all").alias("rule")))


def reduction(n_records: Column, n_candidates: Column) -> Column:
    """Share of all pairs that are candidates."""
    return F.when(n_records > 1, n_candidates / (n_records * (n_records - 1) / 2)).otherwise(F.lit(0.0))
