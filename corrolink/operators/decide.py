"""Linkage decisions: an ordered chain of rules over a pair's comparisons, and what follows from a state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy
from ..functions.text import let
from .compare import total_score

SUPPORT = ("exact_match", "normalized_match")
WEAK = ("weak_discriminator", "contextual_only")
CRITICAL = ("unique_identifier", "strong_discriminator", "moderate_discriminator")


def supports(c: Column) -> Column:
    return c["class"].isin(*SUPPORT)


def categories(comparisons: Column) -> Column:
    """Reliability categories that some positive score stands on."""
    positive = F.filter(comparisons, lambda c: (c["score"] > 0) & ~c["class"].isin("conflict", "strong_conflict"))
    return F.array_distinct(F.transform(positive, lambda c: c["reliability"]))


def decision(comparisons: Column, link: Column | float = policy.LINK_SCORE, review: Column | float = policy.REVIEW_SCORE) -> Column:
    """STRUCT<state, reasons, score>: the first rule that holds.

    Blocking conflicts; a unique identifier that agrees; several strong conflicts without support; only
    weak evidence; enough score over enough categories; else human review.
    """
    given = F.struct(comparisons.alias("c"), total_score(comparisons).alias("score"), categories(comparisons).alias("cats"))
    return let(given, lambda g: _decision(g["c"], g["score"], g["cats"], link, review))


def _decision(comparisons: Column, score: Column, cats: Column, link: Column | float, review: Column | float) -> Column:
    any_ = lambda f: F.exists(comparisons, f)
    blocking = any_(lambda c: c["blocks"])
    blocks_on = lambda f: any_(lambda c: c["blocks"] & f(c))
    block_codes = F.array_compact(F.array(
        F.when(blocks_on(lambda c: c["reliability"] == "unique_identifier"), "government_id_conflict"),
        F.when(blocks_on(lambda c: c["field"] == "date_of_birth"), "date_of_birth_conflict"),
        F.when(blocks_on(lambda c: c["field"] == "distinguishing_marks"), "distinguishing_mark_conflict"),
        F.when(blocks_on(lambda c: c["field"] == "age"), "age_hard_conflict"),
    ))
    strong = F.size(F.filter(comparisons, lambda c: c["class"] == "strong_conflict"))
    supported = any_(supports)
    only = lambda kind: (F.size(cats) == 1) & F.array_contains(cats, kind)
    weak_codes = F.array_compact(F.array(
        F.when((F.size(cats) > 0) & F.forall(cats, lambda x: x.isin(*WEAK)), "insufficient_distinctive_fields"),
        F.when(any_(lambda c: supports(c) & (c["field"] == "full_name")) & only("moderate_discriminator"), "common_name_only"),
        F.when(any_(lambda c: supports(c) & c["field"].contains("location")) & only("contextual_only"), "location_only"),
    ))
    low = F.when((score < review) & (F.size(weak_codes) == 0), F.array(F.lit("no_supporting_evidence"))).otherwise(weak_codes)
    missing = any_(lambda c: c["class"].startswith("missing") & c["reliability"].isin(*CRITICAL))
    review_codes = F.array_compact(F.array(F.when(missing, "missing_key_discriminator"), F.when((strong > 0) & supported, "mixed_signals")))
    out = lambda state, reasons: F.struct(F.lit(state).alias("state"), reasons.alias("reasons"), F.round(score, 4).alias("score"))
    one = lambda code: F.array(F.lit(code))
    return (
        F.when(F.size(comparisons) == 0, out("system_error", one("no_comparisons")))
        .when(blocking, out("blocked_by_conflict", F.when(F.size(block_codes) > 0, block_codes).otherwise(one("multiple_strong_conflicts"))))
        .when(any_(lambda c: supports(c) & (c["reliability"] == "unique_identifier")), out("link_recommended", one("unique_identifier_match")))
        .when((strong >= 2) & ~supported, out("do_not_link", one("multiple_strong_conflicts")))
        .when(F.size(low) > 0, out("insufficient_evidence", low))
        .when((score >= link) & (F.size(cats) >= policy.MIN_CATEGORIES), out("link_recommended", one("multi_field_agreement")))
        .otherwise(out("human_review_required", F.when(F.size(review_codes) > 0, review_codes).otherwise(one("ambiguous_evidence"))))
    )


def classification(state: Column) -> Column:
    return policy.mapped(state, policy.CLASSIFICATION)


def priority(state: Column) -> Column:
    return policy.mapped(state, policy.PRIORITY, F.lit("standard_verification"))


def actions(state: Column) -> Column:
    return policy.mapped(state, {k: ",".join(v) for k, v in policy.ACTIONS.items()}, F.lit("request_more_information,escalate_authorized_review"))


def adjudicated(deterministic: Column, proposed: Column) -> Column:
    """The proposed state where the move is allowed, else the deterministic one; so an adjudicator never raises a decision."""
    allowed = F.lit(False)
    for state, targets in policy.TRANSITIONS.items():
        allowed = allowed | ((deterministic == state) & proposed.isin(*targets))
    return F.when(allowed, proposed).otherwise(deterministic)


def explanation(d: Column) -> Column:
    return F.format_string("%s: %s (score %.4f)", d["state"], F.array_join(d["reasons"], ", "), d["score"])


def majority(votes: DataFrame, key: str, vote: str, order: str) -> DataFrame:
    """(key, winner, unanimous): the vote that most cast; of equal ones the one cast first, then the lesser."""
    counted = votes.groupBy(key, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    return counted.groupBy(key).agg(F.min_by(vote, F.struct(-F.col("n"), F.col("first"), F.col(vote))).alias("winner"), (F.count(F.lit(1)) == 1).alias("unanimous"))


def rival_downgrade(ranked: DataFrame, gap: float = 0.20) -> DataFrame:
    """Scopes whose two best-ranked candidates are within `gap`: recommended links there go back to review."""
    w = Window.partitionBy("scope").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    close = F.abs(F.nth_value("score", 1).over(w) - F.nth_value("score", 2).over(w)) <= gap
    return ranked.withColumn("close", F.coalesce(close, F.lit(False))).withColumn("final_state", F.when(F.col("close") & (F.col("state") == "link_recommended"), "human_review_required").otherwise(F.col("state")))


def close_rivals(candidates: DataFrame, gap: float = 0.15) -> DataFrame:
    """(scope, a, b, rivals): records of other candidates that share a record and come within `gap` of the score."""
    # candidates of one record stand in one list, and each looks through that list: no row is made for two that meet
    ends = candidates.where("scope is not null").select("scope", F.explode(F.array("a", "b")).alias("shared"), F.struct("a", "b", "score").alias("c"))
    lists = ends.where("shared is not null").groupBy("scope", "shared").agg(F.collect_list("c").alias("all"))
    each = lists.select("scope", "shared", "all", F.explode("all").alias("c"))
    near = F.filter("all", lambda o: ((o["a"] != F.col("c.a")) | (o["b"] != F.col("c.b"))) & (F.abs(o["score"] - F.col("c.score")) <= gap))
    rival = F.transform(near, lambda o: F.when(o["a"] == F.col("shared"), o["b"]).otherwise(o["a"]))
    found = each.select("scope", "c.a", "c.b", rival.alias("rivals")).where(F.size("rivals") > 0)
    return found.groupBy("scope", "a", "b").agg(F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_list("rivals"))))).alias("rivals"))
