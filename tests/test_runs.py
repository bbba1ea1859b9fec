"""Runs: every outcome is reached by the registered queries, and the edges of each operator."""

import pytest
from pyspark.sql import functions as F

from corrolink.operators import benchmark_fields, runs
from corrolink.plans import registry

QUERIES = registry.queries()
REACHED = {
    "trial_divergence": ("category", {"injection_quarantine", "abstention", "classification", "evidence_support", "none"}),
    "router_profile": ("profile", {"deterministic_only", "reduced", "full"}),
    "replay_certificate": ("replay_status", {"exact_match", "diverged"}),
    "run_trace": ("status", {"completed", "skipped"}),
    "adaptive_outputs": ("system", {"workflow", "fuzzy"}),
    "candidate_artifact": ("removal_reason", {None, "cap_non_mandatory", "unexpected_strong_removal"}),
    "review_disposition": ("state", {"draft", "authorized_review_in_progress", "authorized_disposition_recorded"}),
}


@pytest.mark.parametrize("name", sorted(REACHED))
def test_every_outcome_is_reached(name, spark):
    column, wanted = REACHED[name]
    assert {r[0] for r in QUERIES[name](spark, "/root/testdata/sf0.01").select(column).distinct().collect()} == wanted


def test_a_case_without_candidates_abstains(spark):
    cases = spark.createDataFrame([(1, [5, 6]), (2, [7, 8])], "case int, record_ids array<int>")
    found = spark.createDataFrame([(1, 2, "possible_candidate", 5, 6), (1, 1, "conflicting_evidence", 5, 9)], "case int, rank int, classification string, a int, b int")
    assert {tuple(r) for r in runs.best_of(cases, found).collect()} == {(1, "conflicting_evidence", False), (2, "insufficient_evidence", False)}


def test_a_missing_output_counts_as_missed(spark):
    truth = spark.createDataFrame([(1, "same_identity", "possible_candidate", False, False)], "case int, relation string, expected string, injected boolean, multilingual boolean")
    out = spark.createDataFrame([("fuzzy", 1, "possible_candidate", True, True)], "system string, case int, actual string, retrieved boolean, resisted boolean")
    recall = {r.system: (r.numerator, r.denominator) for r in runs.system_metrics(truth, out).where("metric_id = 'candidate_recall_at_k'").collect()}
    assert recall == {"workflow": (0, 1), "fuzzy": (1, 1), "generic_call": (0, 1), "structured_call": (0, 1)}


def test_a_missing_checkpoint_diverges(spark):
    old = spark.createDataFrame([(1, 0, "manifest:ranking", "x"), (1, 1, "node:extract:input", "y")], "run int, place int, checkpoint string, hash string")
    got = runs.certificate(old, old.where("place = 0")).first()
    assert (got.replay_status, got.first_divergence, got.observed_hash, got.ranking_consistent) == ("diverged", "node:extract:input", None, True)


def test_ids_and_steps_as_shown(spark):
    row = spark.range(1).select(runs.humanized(F.lit("do_not_link now")).alias("a"), runs.humanized(F.lit("")).alias("b"), runs.refused_nodes(runs.words(("privacy_gate", "extract"))).alias("c"), runs.shown_time(F.lit("2026-04-18 22:02:00").cast("timestamp")).alias("d")).first()
    assert tuple(row) == ("Do Not Link Now", "", ["extract"], "Apr 18, 10:02 PM UTC")


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("Amal Rafiq, DOB 2005", {"name": "Amal Rafiq", "date_of_birth": "2005"}),
        ("Rafiq, Amal", {"name": "Amal Rafiq"}),
        ("age 35, North Gate", {"age": "35", "last_known_location": "age 35, North Gate"[8:]}),
        ("x", {}),
        ("", {}),
        ("Nour Said approximately 14", {"age": "14"}),
        ("Nour Said \u0661\u0664 \u0639\u0627\u0645\u0627", {"age": "14"}),
        ("Lina Noor, registration # AB\u20131234", {"name": "Lina Noor", "government_id": "AB-1234"}),
    ],
)
def test_what_the_benchmark_reads(raw, wanted):
    got = {k: v for k, v, _ in benchmark_fields.fields_of(raw) if k != "phone"}
    assert {k: got.get(k) for k in wanted} == wanted and (wanted or not got)


def test_hedged_ages_and_phones(spark):
    rows = [(1, "Nour Said age 14 - 16, tel: +l-555-3434"), (2, "tel: ((((((((("), (3, None)]
    got = {(r.id, r.key): (r.value, r.certainty) for r in benchmark_fields.extracted(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got[1, "age"] == ("14-16", "estimated") and got[1, "phone"][0] == "+l-555-3434" and not any(i > 1 and k == "phone" for i, k in got)
    raw = spark.createDataFrame([("R1", None, None, None, None)], "record_id string, source_type string, language string, text string, display_name string")
    assert tuple(benchmark_fields.record(raw).first()) == ("R1", "unknown", "English", "", "", "R1", [])
