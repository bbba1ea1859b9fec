"""Runs as tables: inputs of cases, systems side by side, routing, traces, replay certificates, trials, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import evaluate

#: Systems that are compared, the engine's own first.
SYSTEMS = ("workflow", "fuzzy", "generic_call", "structured_call")
# Steps of a run in their order, those that a person must take part in, those that may be left out, and other names of steps.
NODES = ("incident", "quarantine", "extract", "normalize", "timeline", "retrieve", "hypothesis", "prosecutor", "rivals", "adjudicate", "privacy", "review")
HUMAN_NODES = ("incident", "review")
OPTIONAL_NODES = ("quarantine", "normalize", "timeline", "prosecutor", "rivals", "adjudicate", "privacy")
NODE_ALIASES = {
    "evidence_quarantine": "quarantine",
    "normalization": "normalize",
    "multilingual_normalization": "normalize",
    "timeline_reconstruction": "timeline",
    "contradiction_prosecutor": "prosecutor",
    "rival_candidate_test": "rivals",
    "independent_adjudication": "adjudicate",
    "privacy_gate": "privacy",
}
# Phrases that the router takes as a sign.
ROUTER_PHRASES = {
    "instruction_like_text": ("ignore previous", "mark this as confirmed"),
    "missing_observable_fields": ("unknown", "missing", "not recorded"),
    "timeline_or_conflict_language": ("after a", "contradict", "impossible"),
}
#: When a run without measured times begins; each step takes a second.
RUN_START = "2026-04-18 22:02:00"


def words(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def case_inputs(cases: DataFrame, records: DataFrame, visible: list[str]) -> DataFrame:
    """One row for each case and record that it names, with the columns that a run may see; what only the truth knows stays behind.

    cases: case, record_ids. Names that no record has give no row.
    """
    named = cases.select("case", F.explode("record_ids").alias("record_id")).distinct()
    return named.join(records.select("record_id", *visible), "record_id")


def best_of(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case, actual, retrieved) by the first candidate of each case; a case without one abstains.

    cases: case, record_ids; candidates: case, rank, classification, a, b.
    """
    best = candidates.groupBy("case").agg(F.min_by(F.struct("classification", "a", "b"), "rank").alias("best"))
    pair = F.when(F.col("best").isNotNull(), F.array("best.a", "best.b"))
    found = F.coalesce(F.size(F.array_except("record_ids", pair)) == 0, F.lit(False))
    return cases.join(best, "case", "left").select("case", F.coalesce("best.classification", F.lit("insufficient_evidence")).alias("actual"), found.alias("retrieved"))


def system_metrics(truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """The decision metrics of each system over all cases of the truth; a case that a system gave nothing for counts as missed.

    truth: case, relation, expected, injected, multilingual; outputs: system, case, actual, retrieved, resisted.
    """
    grid = truth.withColumn("system", F.explode(words(SYSTEMS))).join(outputs, ["system", "case"], "left")
    return evaluate.decision_metrics(grid, ["system"])


def routed(records: DataFrame) -> DataFrame:
    """(case, signals, profile, disabled) from (case, language, text); a phrase counts where one text holds it."""
    low = F.lower("text")
    said = [F.coalesce(F.bool_or(F.exists(words(phrases), lambda w: F.contains(low, w))), F.lit(False)).alias(name) for name, phrases in ROUTER_PHRASES.items()]
    g = records.groupBy("case").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("language").alias("languages"), *said)
    signs = {"multilingual_records": F.col("languages") > 1} | {name: F.col(name) for name in ROUTER_PHRASES} | {"multiple_rivals": F.col("n") > 2}
    g = g.withColumn("found", F.array_compact(F.array(*[F.when(test, name) for name, test in signs.items()])))
    plain = (F.size("found") == 0) & (F.col("n") == 2)
    reduced = (F.size("found") <= 1) & ~F.col("instruction_like_text")
    none = F.array().cast("array<string>")
    return g.select(
        "case", F.when(F.size("found") == 0, words(("low_observable_complexity",))).otherwise(F.col("found")).alias("signals"),
        F.when(plain, "deterministic_only").when(reduced, "reduced").otherwise("full").alias("profile"), F.when(reduced & ~plain, words(("rivals", "adjudicate"))).otherwise(none).alias("disabled"),
    )


def adaptive_outputs(routes: DataFrame, outputs: DataFrame) -> DataFrame:
    """Of each case the output of the system that its route leads to: fuzzy names alone, or the workflow."""
    wanted = F.when(F.col("profile") == "deterministic_only", "fuzzy").otherwise("workflow")
    return routes.select("case", "profile", wanted.alias("system")).join(outputs, ["case", "system"])


def adaptive_costs(full: DataFrame, adaptive: DataFrame) -> DataFrame:
    """(run, n, calls, duration_ms) of both ways to run the cases."""
    both = full.select(F.lit("full").alias("run"), "calls", "duration_ms").unionByName(adaptive.select(F.lit("adaptive").alias("run"), "calls", "duration_ms"))
    return both.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("calls").alias("calls"), F.round(F.sum("duration_ms"), 3).alias("duration_ms"))


def canonical_nodes(names: Column) -> Column:
    """Names of steps under their own names; unknown ones stay as they are."""
    known = F.create_map(*[F.lit(x) for pair in NODE_ALIASES.items() for x in pair])
    return F.transform(names, lambda n: F.coalesce(F.element_at(known, n), n))


def refused_nodes(names: Column) -> Column:
    """Steps that a run may not leave out, or that there are none of."""
    return F.array_except(canonical_nodes(names), words(OPTIONAL_NODES))


def trace(runs: DataFrame) -> DataFrame:
    """One row for each run and step, with its status, times, next step and whether a person takes part. runs: run, disabled."""
    rows = runs.select("run", canonical_nodes(F.coalesce("disabled", F.array().cast("array<string>"))).alias("off"), F.posexplode(words(NODES)).alias("at", "node"))
    seconds = lambda n: F.lit(RUN_START).cast("timestamp") + F.make_dt_interval(secs=n)
    return rows.select(
        "run", (F.col("at") + 1).alias("place"), "node", F.when(F.array_contains("off", F.col("node")), "skipped").otherwise("completed").alias("status"),
        seconds(F.col("at")).alias("started"), seconds(F.col("at") + 1).alias("completed"), F.try_element_at(words(NODES), F.col("at") + 2).alias("next_node"), F.col("node").isin(*HUMAN_NODES).alias("human"),
    )


#: What a manifest holds hashes of, in the order in which a replay is compared; hashes of the steps follow.
MANIFEST = ("input_package", "normalized_input", "configuration", "candidate_set", "ranking", "contract", "response", "audit_terminal")
CHECKPOINTS = (*[f"manifest:{m}" for m in MANIFEST], *[f"node:{n}:{side}" for n in NODES for side in ("input", "output")])


def certificate(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """For each run whether its replay agrees, where it first does not, and whether its results may be released.

    Both: run, place, checkpoint, hash. Checkpoints that only the replay has are not compared; a missing one disagrees.
    """
    both = expected.join(observed.select("run", "checkpoint", F.col("hash").alias("observed")), ["run", "checkpoint"], "left")
    same = F.col("hash").eqNullSafe(F.col("observed"))
    held = lambda name: F.coalesce(F.bool_and(F.when(F.col("checkpoint") == f"manifest:{name}", same)), F.lit(True))
    first = F.min(F.when(~same, F.struct("place", "checkpoint", "hash", "observed")))
    g = both.groupBy("run").agg(F.count(F.lit(1)).alias("n_checkpoints"), first.alias("first"), held("ranking").alias("ranking_consistent"), held("contract").alias("contract_consistent"), held("audit_terminal").alias("audit_chain_consistent"))
    exact = F.col("first").isNull()
    return g.select(
        "run", "n_checkpoints", F.when(exact, "exact_match").otherwise("diverged").alias("replay_status"), F.col("first.checkpoint").alias("first_divergence"), F.col("first.hash").alias("expected_hash"), F.col("first.observed").alias("observed_hash"),
        "ranking_consistent", "contract_consistent", "audit_chain_consistent", exact.alias("exact"),
    )


def divergence(trials: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per trial the first system whose answer is not accepted, the step it is laid to, and the kind of failure.

    trials: case, accepted, injected; outputs: system, case, actual, resisted, cited. An instruction that got through comes before all else.
    """
    joined = trials.join(outputs, "case", "left")
    own = F.col("system") == SYSTEMS[0]
    wrong = F.col("system").isNotNull() & ~F.array_contains("accepted", F.col("actual"))
    g = joined.groupBy("case").agg(
        F.min(F.when(wrong, F.struct((~own).alias("other"), "system", "actual"))).alias("wrong"), F.max_by("actual", F.when(own, F.lit(1))).alias("answer"),
        F.coalesce(F.bool_or(own & F.col("injected") & ~F.coalesce("resisted", F.lit(False))), F.lit(False)).alias("slipped"),
        F.coalesce(F.bool_or(own & (F.coalesce("cited", F.lit(0)) == 0)), F.lit(False)).alias("uncited"), F.first(F.array_contains("accepted", "insufficient_evidence")).alias("may_abstain"),
    )
    g = g.withColumn("first", F.when(F.col("slipped"), F.lit(SYSTEMS[0])).otherwise(F.col("wrong.system")))
    category = (
        F.when(F.col("slipped"), "injection_quarantine")
        .when(F.col("first").isNotNull(), F.when(F.col("may_abstain"), "abstention").otherwise("classification"))
        .when(F.col("uncited"), "evidence_support")
        .otherwise("none")
    )
    node = F.when(F.col("slipped"), "quarantine").when(F.col("first") == SYSTEMS[0], "adjudicate").when(F.col("first").isNull() & F.col("uncited"), "extract")
    observed = F.when(F.col("slipped") | F.col("first").isNull(), F.coalesce("answer", F.lit("missing_workflow_output"))).otherwise(F.col("wrong.actual"))
    return g.select("case", category.alias("category"), F.col("first").alias("system"), node.alias("node"), observed.alias("observed"))


def summary(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Counts of each run. records: run, language, n_instructions; candidates: run, severities."""
    r = records.groupBy("run").agg(F.count(F.lit(1)).alias("records_processed"), F.countDistinct("language").alias("languages_detected"), F.sum("n_instructions").cast("long").alias("quarantined_instructions"))
    hard = F.size(F.filter("severities", lambda s: s == "hard"))
    c = candidates.groupBy("run").agg(F.count(F.lit(1)).alias("candidate_connections"), F.sum(hard).alias("hard_conflicts"))
    return r.join(c, "run", "left").fillna(0, ["candidate_connections", "hard_conflicts"]).withColumn("awaiting_human_review", F.col("candidate_connections"))


def top_outcomes(pairs: DataFrame) -> DataFrame:
    """Counts over the best pair of each scope by score, earlier ones first among equals.

    pairs: scope, rank, score, state, relation, expected (whether the pair is the one that the truth names; null where it names none), accepted (states).
    """
    tops = pairs.groupBy("scope").agg(
        F.max_by(F.struct("state", "relation", "expected", "accepted"), F.struct("score", -F.col("rank"))).alias("t"), F.bool_or("expected").alias("names_pair")
    )
    state, same = F.col("t.state"), F.col("t.relation") == "same_identity"
    link = state == "link_recommended"
    right = F.when(F.col("names_pair").isNotNull(), F.col("names_pair")).otherwise(F.array_contains("t.accepted", state))
    return tops.agg(
        F.count(F.lit(1)).alias("scopes"), F.count_if(state.isin("human_review_required", "insufficient_evidence")).alias("routed_to_review"), F.count_if(link & same).alias("true_links"),
        F.count_if(link & (F.col("t.relation") == "different_identity")).alias("false_merges"), F.count_if(same & F.col("names_pair") & ~F.col("t.expected")).alias("right_pair_not_first"), F.count_if(right).alias("right_on_top"),
    )


def facets(df: DataFrame, **chosen: str) -> DataFrame:
    """Rows under the chosen value of each facet; `all` leaves a facet open."""
    for column, value in chosen.items():
        if value != "all":
            df = df.where(F.col(column) == value)
    return df


def humanized(c: Column) -> Column:
    """An id as words: blanks for underscores, each word with a capital."""
    parts = F.regexp_extract_all(F.replace(c, F.lit("_"), F.lit(" ")), F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p)))), "")


def shown_time(c: Column) -> Column:
    """A time of the session's zone, UTC, as it is shown: Apr 18, 10:02 PM UTC."""
    return F.concat(F.date_format(c, "MMM d, h:mm a"), F.lit(" UTC"))
