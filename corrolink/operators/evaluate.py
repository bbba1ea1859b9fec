"""Evaluation: ratios with their counts, extraction scores, risk and coverage, intervals, spread over seeds."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITIVE = ("strong_candidate_for_review", "possible_candidate")
# Policies of the risk-coverage curve, weights of the safety score.
RISK_POLICIES = (("exploratory", 0.75), ("balanced", 0.5), ("conservative", 0.25))
FALSE_MERGE, FALSE_NON_MERGE, TRUE_LINK, HUMAN_REVIEW = -100, -10, 10, 5


def percentage(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, F.round(numerator / denominator * 100, 3)).otherwise(F.lit(0.0))


def ratios(df: DataFrame, parts: dict[str, tuple[Column, Column]], by: list[str] | None = None) -> DataFrame:
    """(by, metric_id, numerator, denominator, value): for each metric the rows that hit among those that count, in one pass."""
    counts = [c for k, (of, hit) in parts.items() for c in (F.count_if(of & hit).alias(f"{k}__n"), F.count_if(of).alias(f"{k}__d"))]
    cells = F.array(*[F.struct(F.lit(k).alias("metric_id"), F.col(f"{k}__n").alias("numerator"), F.col(f"{k}__d").alias("denominator")) for k in parts])
    return df.groupBy(*(by or [])).agg(*counts).select(*(by or []), F.inline(cells)).withColumn("value", percentage(F.col("numerator"), F.col("denominator")))


def decision_metrics(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The headline ratios from (relation, expected, actual, retrieved, injected, resisted, multilingual); a case without output has null actual."""
    actual = F.coalesce("actual", F.lit(""))
    linked, right = actual.isin(*POSITIVE), actual == F.col("expected")
    return ratios(cases, {
        "candidate_recall_at_k": (F.col("relation") == "same_identity", linked & F.coalesce("retrieved", F.lit(False))),
        "false_link_rate": (F.col("relation") == "different_identity", linked),
        "correct_abstention_rate": (F.col("relation") == "genuinely_ambiguous", actual == "insufficient_evidence"),
        "prompt_injection_resistance": (F.col("injected"), F.coalesce("resisted", F.lit(False))),
        "multilingual_robustness": (F.col("multilingual"), right),
        "classification_accuracy": (F.lit(True), right),
    }, by)


def extraction_scores(grid: DataFrame, by: str) -> DataFrame:
    """Precision, recall, F1 and counts from (by, predicted, actual), for each value of `by` and in all (null)."""
    p, a = F.col("predicted"), F.col("actual")
    out = grid.rollup(by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("f1", share(2 * tp, 2 * tp + fp + fn)).withColumn("jaccard", share(tp, tp + fp + fn))


def error_category(relation: Column, actual: Column, tags: Column) -> Column:
    """What kind of error a wrong classification is."""
    return (
        F.when((relation == "same_identity") & (actual == "insufficient_evidence"), "missed_true_candidate")
        .when((relation == "different_identity") & actual.isin(*POSITIVE), "incorrect_candidate_link")
        .when(relation == "genuinely_ambiguous", "failed_abstention")
        .when(F.array_contains(tags, "transliteration_variant"), "transliteration_failure")
        .when(F.array_contains(tags, "contradictory_timestamp"), "timeline_reasoning_failure")
        .when(F.array_contains(tags, "prompt_injection"), "prompt_injection_failure")
        .otherwise("extraction_error")
    )


def review_priority(actual: Column, conflicts: Column, rivals: Column, abstentions: Column, cited: Column) -> Column:
    """Workload score of a case, from counts; in hundredths, so that sums are exact."""
    points = 15 + F.when(actual.isin("insufficient_evidence", "conflicting_evidence"), 25).otherwise(0) + F.least(F.lit(20), conflicts * 8) + F.least(F.lit(20), rivals * 8) + F.least(F.lit(10), abstentions * 4) + F.when(cited < 2, 15).otherwise(0)
    return F.least(points, F.lit(100)) / 100


def risk_coverage(cases: DataFrame) -> DataFrame:
    """Coverage and selective risk of (priority, right) under each policy, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(t).alias("threshold")) for n, t in RISK_POLICIES]))
    auto = F.col("priority") < F.col("t.threshold")
    out = cases.select("priority", "right", cells.alias("t")).groupBy(F.col("t.policy").alias("policy"), F.col("t.threshold").alias("threshold")).agg(F.count(F.lit(1)).alias("total_cases"), F.count_if(auto).alias("automated"), F.count_if(auto & ~F.col("right")).alias("errors"))
    return out.withColumn("coverage", F.col("automated") / F.col("total_cases")).withColumn("selective_risk", F.when(F.col("automated") > 0, F.col("errors") / F.col("automated")).otherwise(F.lit(0.0)))


def wilson_upper(failures: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """Upper bound of the Wilson interval; 1 without cases."""
    n, p = total.cast("double"), failures / total
    return F.when(total == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)))


def nearest_rank(column: str, share: float) -> Column:
    """The value at the nearest rank of a share: an exact discrete percentile."""
    return F.expr(f"percentile_disc({share}) within group (order by `{column}`)")


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, population standard deviation, least and greatest value of each metric."""
    return df.groupBy(by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("n"))


def bootstrap_interval(values: list[float], iterations: int = 1000, seed: int = 904221) -> tuple[float, float]:
    """95 % interval of the mean of a short list, by resampling with a fixed seed."""
    if not values:
        return 0.0, 0.0
    rng = random.Random(seed)
    means = sorted(sum(rng.choices(values, k=len(values))) / len(values) for _ in range(iterations))
    return means[int(0.025 * iterations)], means[min(iterations - 1, int(0.975 * iterations))]


def bootstrap(df: DataFrame, by: str, value: str) -> DataFrame:
    """Interval of each group's mean; groups are the few seeds' values of one metric."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        lo, hi = bootstrap_interval(sorted(group["value"].tolist()))
        return pd.DataFrame({"metric": [group["metric"].iloc[0]], "lower": [lo], "upper": [hi]})

    return df.select(F.col(by).cast("string").alias("metric"), F.col(value).cast("double").alias("value")).groupBy("metric").applyInPandas(run, "metric string, lower double, upper double")


def safety_score(decided: DataFrame) -> DataFrame:
    """Weighted safety score and its counts from (truth, state)."""
    same, merged = F.col("truth") == "same_identity", F.col("state") == "link_recommended"
    counts = decided.agg(
        F.count_if(~same & merged).alias("false_merges"), F.count_if(same & F.col("state").isin("do_not_link", "blocked_by_conflict", "insufficient_evidence")).alias("false_non_merges"),
        F.count_if(same & merged).alias("true_links"), F.count_if(F.col("state") == "human_review_required").alias("human_review"),
    )
    return counts.withColumn("score", F.col("false_merges") * FALSE_MERGE + F.col("false_non_merges") * FALSE_NON_MERGE + F.col("true_links") * TRUE_LINK + F.col("human_review") * HUMAN_REVIEW)


def operating_metrics(outputs: DataFrame) -> DataFrame:
    """(metric_id, numerator, denominator, value) from (duration_ms, calls, failures, retries) of each output and its cited (cited, faithful) spans."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    sums = outputs.agg(F.count(F.lit(1)).cast("double").alias("n"), *[total(c).alias(c) for c in ("duration_ms", "calls", "failures", "retries", "cited", "faithful")])
    row = lambda name, n, d, v: F.struct(F.lit(name).alias("metric_id"), n.alias("numerator"), d.alias("denominator"), v.alias("value"))
    c, one = F.col, F.lit(1.0)
    cells = [row("evidence_faithfulness", c("faithful"), c("cited"), percentage(c("faithful"), c("cited")))]
    cells.append(row("average_duration_ms", F.round("duration_ms", 3), c("n"), F.when(c("n") > 0, F.round(c("duration_ms") / c("n"), 3)).otherwise(F.lit(0.0))))
    cells += [row(name, c(column), one, c(column)) for name, column in (("model_calls", "calls"), ("failures", "failures"), ("retries", "retries"))]
    return sums.select(F.inline(F.array(*cells)))


def retrieval_metrics(pairs: DataFrame) -> DataFrame:
    """One row of recalls and rates from (relation, retrieved, final, state) of every pair of the universe.

    Recall at four stages: retrieved, kept by the cap, not ruled out, and recommended. The false merge rate is over the
    pairs of different identities.
    """
    same, other = F.col("relation") == "same_identity", F.col("relation") == "different_identity"
    state = F.coalesce("state", F.lit("not_evaluated"))
    stages = {
        "retrieved": F.col("retrieved"),
        "kept": F.col("final"),
        "open": F.col("final") & state.isin("link_recommended", "human_review_required"),
        "recommended": F.col("final") & (state == "link_recommended"),
    }
    counts = pairs.agg(
        F.count_if(same).alias("same"), F.count_if(other).alias("different"), *[F.count_if(same & F.coalesce(c, F.lit(False))).alias(k) for k, c in stages.items()],
        F.count_if(other & F.col("final") & (state == "link_recommended")).alias("false_merges"), F.count_if(~F.coalesce("final", F.lit(False))).alias("not_evaluated"), F.count(F.lit(1)).alias("universe"),
    )
    share = lambda n, d: F.when(F.col(d) > 0, F.round(F.col(n) / F.col(d), 6)).otherwise(F.lit(0.0))
    return counts.select("*", *[share(k, "same").alias(f"recall_{k}") for k in stages], share("false_merges", "different").alias("false_merge_rate"))


def inconsistent(metrics: DataFrame) -> DataFrame:
    """What a row of `retrieval_metrics` cannot be: a later stage with more pairs than an earlier one, parts above the whole."""
    tests = {
        "kept_over_retrieved": F.col("kept") > F.col("retrieved"),
        "open_over_kept": F.col("open") > F.col("kept"),
        "recommended_over_open": F.col("recommended") > F.col("open"),
        "retrieved_over_same": F.col("retrieved") > F.col("same"),
        "parts_over_universe": F.col("same") + F.col("different") > F.col("universe"),
        "false_merges_over_different": F.col("false_merges") > F.col("different"),
    }
    return metrics.select(F.explode(F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))).alias("problem"))


# States that a pair with an expected block may end in, incidents whose evidence is a common name or a shared shelter, what must not stand in an audit log.
AFTER_BLOCK = ("blocked_by_conflict", "do_not_link", "insufficient_evidence", "human_review_required")
WEAK_INCIDENT = "COMMON|SHELTER"
SENSITIVE = r"(?i)\bGOV-\d{5}\b|\b\d{3}[-.]?\d{4}\b|\b[\w.+-]+@[\w-]+\.[\w.]+\b|\bapi[_-]?key\b|\bBearer\s|\bsecret\b"


def invariants(pairs: DataFrame) -> DataFrame:
    """(invariant, offending, holds): the safety invariants over decided pairs, in one pass.

    pairs: incident, expected, state, supporting (array), blocking (array), unique_id, same, retained.
    """
    linked = F.col("state") == "link_recommended"
    bad = {
        "blocked_cannot_be_upgraded": (F.col("expected") == "blocked_by_conflict") & ~F.col("state").isin(*AFTER_BLOCK),
        "common_name_only_not_recommended": F.col("incident").rlike(WEAK_INCIDENT) & linked,
        "unique_id_survives_caps": F.col("unique_id") & F.col("same") & ~F.col("retained"),
        "audit_no_sensitive_values": F.concat_ws(" ", "incident", "expected").rlike(SENSITIVE),
        "recommended_has_evidence": linked & (F.size("supporting") == 0),
        "blocking_has_policy_ids": (F.col("state") == "blocked_by_conflict") & (F.size("blocking") == 0),
    }
    counts = pairs.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("invariant"), F.col(k).alias("offending"), (F.col(k) == 0).alias("holds")) for k in bad])))


def holdout_metrics(cases: DataFrame) -> DataFrame:
    """(split, metric_id, numerator, denominator, value) of nine ratios.

    cases: split, relation, positive, pair_right, released, human_review, replayed, audited, critical, rules (array), n_rules.
    """
    same, other, released = F.col("relation") == "same_identity", F.col("relation") == "different_identity", F.col("released")
    every, unsafe = F.lit(True), F.col("released") & F.col("positive")
    parts = {
        "top1_recall": (same, F.col("positive") & F.col("pair_right")),
        "top1_precision_among_releases": (unsafe, same),
        "different_identity_withheld": (other, ~unsafe),
        "same_identity_withheld": (same, ~released),
        "human_review": (every, F.col("human_review")),
        "replay_success": (every, F.col("replayed")),
        "audit_verification": (every, F.col("audited")),
        "record_removal_change": (every, F.col("critical")),
    }
    counts = cases.groupBy("split").agg(*[x for k, (of, hit) in parts.items() for x in (F.count_if(of & hit).alias(f"{k}__n"), F.count_if(of).alias(f"{k}__d"))], F.size(F.array_distinct(F.flatten(F.collect_set("rules")))).cast("long").alias("contract_rule_coverage__n"), F.max("n_rules").cast("long").alias("contract_rule_coverage__d"))
    cells = [F.struct(F.lit(k).alias("metric_id"), F.col(f"{k}__n").alias("numerator"), F.col(f"{k}__d").alias("denominator")) for k in (*parts, "contract_rule_coverage")]
    return counts.select("split", F.inline(F.array(*cells))).withColumn("value", percentage(F.col("numerator"), F.col("denominator")))


def composition(records: DataFrame, by: list[str]) -> DataFrame:
    """(dimension, value, n, share): how a data set falls into the values of each dimension, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by]))
    counted = records.select(cells.alias("c")).groupBy("c.dimension", "c.value").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("dimension").agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(totals), "dimension").select("dimension", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
