"""Evidence contracts: each rule is a table of violations; rules roll up to canonical ones, and those decide release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy, text

# Canonical rules and the rules under each; the two that ask for review only; provenance of claim types.
CANONICAL = {
    "SOURCE_SPAN_INTEGRITY": ("EC-001", "EC-002"),
    "CLAIM_LINEAGE_COMPLETE": ("EC-003", "EC-004", "EC-005"),
    "CERTAINTY_PRESERVED": ("EC-006",),
    "TIMELINE_CONSISTENCY": ("EC-012",),
    "MATERIAL_CONTRADICTIONS_RESOLVED": ("EC-007",),
    "RIVAL_EXPLANATION_COVERAGE": ("EC-008", "EC-016"),
    "REQUIRED_SAFETY_NOTICE_PRESENT": ("EC-018",),
    "HUMAN_REVIEW_ROUTING_VALID": ("EC-009", "EC-013", "EC-017"),
    "AUDIT_EVENT_READY": ("EC-014", "EC-015"),
    "RELEASE_AUTHORIZATION_VALID": ("EC-010", "EC-011"),
}
REVIEW_ONLY = ("EC-016", "EC-017")
PROVENANCE = {"extracted_fact": "extract", "normalized_representation": "normalize", "timeline_interpretation": "timeline", "compatibility_claim": "hypothesis", "contradiction_claim": "prosecutor", "rival_comparison_claim": "rivals"}


def rank(certainty: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, r in policy.CERTAINTY_RANK.items():
        out = F.when(certainty == name, F.lit(r)).otherwise(out)
    return out


def claim_rules(claims: DataFrame) -> DataFrame:
    """(contract, claim, rule) of each violation that a claim shows by itself or with its parent.

    claims: contract, claim, claim_type, node, parent, certainty, span_certainty, record, declared_record, quote, source
    text, start, end, supported, extraction_status, output.
    """
    parent = claims.select("contract", F.col("claim").alias("parent"), F.col("certainty").alias("parent_certainty"))
    c = claims.join(parent, ["contract", "parent"], "left")
    derived = F.col("claim_type") != "extracted_fact"
    at = F.expr("substring(source, start + 1, end - start)")
    tests = {
        "EC-001": ~F.col("supported") | F.col("source").isNull() | (F.col("start") < 0) | (F.col("end") > F.length("source")) | (at != F.col("quote")),
        "EC-002": F.col("record") != F.col("declared_record"),
        "EC-003": F.col("node") != policy.mapped(F.col("claim_type"), PROVENANCE),
        "EC-004": (derived & F.col("parent").isNull()) | (F.col("parent").isNotNull() & F.col("parent_certainty").isNull()),
        "EC-005": (F.col("claim_type") == "normalized_representation") & F.col("parent").isNull(),
        "EC-006": (F.col("span_certainty") != F.col("certainty")) | (rank(F.col("certainty")) > rank(F.col("parent_certainty"))),
        "EC-010": F.col("extraction_status") == "quarantined",
        "EC-011": text.has_forbidden_language(F.col("output")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(rule)) for rule, t in tests.items()]))
    return c.select("contract", "claim", F.explode(found).alias("rule"))


def contract_rules(contracts: DataFrame) -> DataFrame:
    """(contract, claim, rule) of violations of a contract as a whole. claim is null.

    contracts: contract, classification, routed_classification (null: no candidate), hard_conflicts, considered, routed,
    close_rivals, rivals (arrays), block_conflicts, complete, chain_valid, replay_valid, n_abstentions, n_sources,
    n_critical (counterfactuals over supporting evidence), safety_notice. A null complete, chain_valid or replay_valid was not looked at.
    """
    gap = lambda a, b: F.size(F.array_except(a, b)) > 0
    strong = F.col("classification") == "strong_candidate_for_review"
    conflicting, candidate = F.size("hard_conflicts") > 0, F.col("routed_classification").isNotNull()
    closed = conflicting & F.col("block_conflicts")
    tests = {
        "EC-007": gap("hard_conflicts", "considered") | gap("hard_conflicts", "routed") | closed,
        "EC-008": strong & gap("close_rivals", "rivals"),
        "EC-009": ~F.col("complete"),
        "EC-012": candidate & ((F.col("routed_classification") != F.col("classification")) | (conflicting & (F.col("classification") != "conflicting_evidence")) | closed),
        "EC-013": candidate & (F.col("classification") == "insufficient_evidence") & (F.col("n_abstentions") == 0),
        "EC-014": ~F.col("chain_valid"),
        "EC-015": ~F.col("replay_valid"),
        "EC-016": strong & (F.col("n_sources") < 2),
        "EC-017": strong & (F.col("n_critical") == 0),
        "EC-018": ~F.col("safety_notice"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(rule)) for rule, t in tests.items()]))
    return contracts.select("contract", F.lit(None).cast("long").alias("claim"), F.explode(found).alias("rule"))


def canonical(rule: Column) -> Column:
    return policy.mapped(rule, {r: k for k, rules in CANONICAL.items() for r in rules})


def release(contracts: DataFrame, violations: DataFrame) -> DataFrame:
    """(contract, n_violations, blocked_rules, status, released): blocked by any violation but those that ask for review only."""
    v = violations.groupBy("contract").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(~F.col("rule").isin(*REVIEW_ONLY), canonical(F.col("rule"))))).alias("blocked_rules"), F.count_if(F.col("rule").isin(*REVIEW_ONLY)).alias("asks")
    )
    joined = contracts.select("contract").join(v, "contract", "left")
    blocked = F.coalesce(F.array_join("blocked_rules", ","), F.lit(""))
    status = F.when(blocked != "", "blocked").when(F.coalesce("asks", F.lit(0)) > 0, "review_required").otherwise("verified")
    return joined.select("contract", F.coalesce("n", F.lit(0)).alias("n_violations"), blocked.alias("blocked_rules"), status.alias("status"), (status == "verified").alias("released"))


def release_view(decisions: DataFrame, released: DataFrame, columns: list[str], key: str = "contract") -> DataFrame:
    """decisions with the given columns null unless the contract is released."""
    joined = decisions.join(released.select(key, "released"), key, "left")
    shown = F.coalesce("released", F.lit(False))
    return joined.select(*[F.when(shown, F.col(c)).alias(c) if c in columns else F.col(c) for c in decisions.columns], shown.alias("released"))
