"""What the reasoning steps make of decided pairs: factors, cited hypotheses, restored conflicts, rivals, and values held against texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.policy import mapped

# What the class of a comparison says of a factor, and the longest time that may go backwards.
FACTOR_STATUS = {
    "exact_match": "compatible",
    "normalized_match": "compatible",
    "compatible": "compatible",
    "partial_match": "soft_conflict",
    "strong_conflict": "hard_conflict",
    "conflict": "uncertain",
}
BACKWARDS_MINUTES = 30
PHONE_DIGITS = 7


def factor_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and (factor, field, status, conflict): a row for each comparison that misses nothing; conflict names a hard one."""
    rows = pairs.select(*keys, F.explode("comparisons").alias("c")).where(~F.col("c.class").startswith("missing_"))
    status = F.coalesce(mapped(F.col("c.class"), FACTOR_STATUS), F.lit("missing"))
    name = lambda front: F.concat(F.lit(front), F.upper("c.field"))
    return rows.select(*keys, name("CF-").alias("factor"), F.col("c.field").alias("field"), status.alias("status"), F.when(status == "hard_conflict", name("CONFLICT-")).alias("conflict"))


def score_rows(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and (field, value): the comparisons that add to the score, and those that miss something."""
    rows = pairs.select(*keys, F.explode("comparisons").alias("c"))
    return rows.where((F.col("c.score") > 0) | F.col("c.class").startswith("missing_")).select(*keys, F.col("c.field").alias("field"), F.col("c.score").alias("value"))


def cites_valid(cited: Column, valid: Column) -> Column:
    """Whether a hypothesis cites something, and nothing but valid spans."""
    return (F.size(cited) > 0) & F.forall(cited, lambda s: F.array_contains(valid, s))


def restored(blocking: Column, reported: Column) -> Column:
    """The conflicts of a report with the blocking ones that it left out put back behind them."""
    return F.concat(reported, F.array_sort(F.array_except(blocking, reported)))


def rule_changes(before: Column, after: Column) -> Column:
    """STRUCT<triggered, resolved>: rules on one side only."""
    return F.struct(F.array_sort(F.array_except(after, before)).alias("triggered"), F.array_sort(F.array_except(before, after)).alias("resolved"))


def rivals(candidates: DataFrame, limit: int) -> DataFrame:
    """(scope, candidate, rival, name, hard): each candidate of a scope against each other one, the first `limit` in order of rank.

    candidates: scope, candidate, rank, name_score, blocked. A scope keeps no more candidates than the retrieval cap lets
    through, so the join is bounded by that cap.
    """
    side = lambda s: candidates.select("scope", *[F.col(c).alias(f"{s}_{c}") for c in ("candidate", "rank", "name_score", "blocked")])
    met = side("p").join(side("o"), "scope").where("p_candidate <> o_candidate")
    name = F.when(F.col("p_name_score") > F.col("o_name_score"), "stronger").when(F.col("p_name_score") < F.col("o_name_score"), "weaker").otherwise("unresolved")
    place = F.row_number().over(Window.partitionBy("scope", "p_candidate").orderBy("o_rank", "o_candidate"))
    return met.withColumn("place", place).where(F.col("place") <= limit).select("scope", F.col("p_candidate").alias("candidate"), F.col("o_candidate").alias("rival"), name.alias("name"), F.when(F.col("o_blocked"), "conflicting").otherwise("unresolved").alias("hard"))


def timeline_compatible(a: Column, b: Column) -> Column:
    """Whether the clock times of two whole texts can follow each other; a text without time leaves it open, which passes."""
    x, y = text.clock_minutes(a), text.clock_minutes(b)
    return F.coalesce((y >= x) | (F.abs(y - x) <= BACKWARDS_MINUTES), F.lit(True))


def value_fidelity(key: Column, value: Column, expected: Column, source: Column) -> Column:
    """How an extracted value stands to the expected one and to the text it was taken from."""
    v, e, t = F.lower(F.trim(value)), F.coalesce(F.lower(F.trim(expected)), F.lit("")), F.lower(source)
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    return (
        F.when(value.isNull() | (value == ""), "omitted")
        .when((e == "") & (v != "") & ~F.contains(t, v), "hallucinated")
        .when((e == "") | (v == e), "exact_match")
        .when((key == "phone") & (digits(v) == digits(e)) & (F.length(digits(v)) >= PHONE_DIGITS), "normalization_equivalent")
        .when((key == "date_of_birth") & (F.contains(e, v) | F.contains(v, e)), "partial_usable")
        .when(F.contains(t, v), "exact_match")
        .otherwise("incorrect")
    )


# ---- the universe of pairs, and what retrieval made of it


def universe(records: DataFrame, scope: str, record: str, place: str) -> DataFrame:
    """(scope, a, b): all pairs of a scope's records, the one that stands first in the input first. For scopes of bounded size (incidents)."""
    side = lambda s: records.select(F.col(scope).alias("scope"), F.col(record).alias(s), F.col(place).alias(f"{s}_at"))
    return side("a").join(side("b"), "scope").where("a_at < b_at").select("scope", "a", "b")


def unordered(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def not_retrieved(truth: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Pairs of one identity that retrieval did not give, in either order. Both: scope, a, b; truth also relation."""
    key = ["scope", "pair"]
    found = retrieved.select("scope", unordered(F.col("a"), F.col("b")).alias("pair")).distinct()
    return truth.where("relation = 'same_identity'").withColumn("pair", unordered(F.col("a"), F.col("b"))).join(found, key, "left_anti").select("scope", "a", "b")


def best_by_score(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each scope by score; ties go by the records' order."""
    w = Window.partitionBy("scope").orderBy(F.desc("score"), "a", "b")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def artifact(pairs: DataFrame, final: DataFrame, truth: DataFrame, decisions: DataFrame) -> DataFrame:
    """Of every pair: its rank before the cap, its final rank, whether it stayed and if not why, its truth and its decision.

    pairs: scope, a, b, rank, mandatory; final: those that stayed, with final_rank; truth: relation; decisions: state, score.
    """
    key = ["scope", "a", "b"]
    joined = pairs.join(final.select(*key, "final_rank"), key, "left").join(truth.select(*key, "relation"), key, "left").join(decisions.select(*key, "state", "score"), key, "left")
    stayed = F.col("final_rank").isNotNull()
    reason = F.when(~stayed, F.when(F.col("mandatory"), "unexpected_strong_removal").otherwise("cap_non_mandatory"))
    return joined.select(*key, "rank", "final_rank", "mandatory", stayed.alias("retained"), reason.alias("removal_reason"), F.coalesce("relation", F.lit("unlabeled")).alias("relation"), F.col("state").isNotNull().alias("evaluated"), "state", F.round("score", 4).alias("score"))
