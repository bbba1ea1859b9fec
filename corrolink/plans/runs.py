"""Queries of runs, systems, routing, replay and trials, and of the views of a workspace, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import benchmark_fields, runs
from .evidence import _CASES_SQL, _METRICS, _cases
from .reasoning import _STATES, _UNIVERSE_SQL, _universe, pick
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(fn):
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


_CLASSES = ("strong_candidate_for_review", "possible_candidate", "insufficient_evidence", "conflicting_evidence")
_AT = lambda values, at: f"list_extract({list(values)}, CAST({at} AS INTEGER) + 1)"


# ---- cases and systems: a case is a labelled document or a customer


@query('SELECT l.doc_id AS "case", x.doc_id AS record_id, lang, n_chars FROM labels l JOIN documents x ON x.doc_id IN (l.doc_id, l.doc_id + 1)')
def case_inputs(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "labels").select(F.col("doc_id").alias("case"), F.array("doc_id", F.col("doc_id") + 1, "doc_id").alias("record_ids"))
    return runs.case_inputs(cases, table(spark, d, "documents").withColumnRenamed("doc_id", "record_id"), ["lang", "n_chars"])


@query(
    f"""WITH f AS (SELECT o_custkey AS k, {_AT(_CLASSES, "o_orderkey % 4")} AS cl, o_orderkey % 3 AS step FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)
SELECT c_custkey AS "case", coalesce(cl, 'insufficient_evidence') AS actual, coalesce(step = 1, false) AS retrieved FROM customer LEFT JOIN f ON k = c_custkey"""
)
def workflow_outputs(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("case"), F.array("c_custkey", F.col("c_custkey") + 1).alias("record_ids"))
    o = F.col("o_orderkey")
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("case"), o.alias("rank"), pick(_CLASSES, o % 4).alias("classification"), F.col("o_custkey").alias("a"), (F.col("o_custkey") + o % 3).alias("b"))
    return runs.best_of(cases, found)


_OUTPUTS_SQL = f"""y AS (SELECT unnest({list(runs.SYSTEMS)}) AS system, unnest([0, 1, 2, 3]) AS s),
o AS (SELECT doc_id, system, {_AT(_CLASSES, "(doc_id + s * (doc_id % 2)) % 4")} AS actual, (doc_id + s) % 3 > 0 AS retrieved, (doc_id * 3 + s) % 4 > 0 AS resisted, (doc_id + s) % 3 AS cited FROM labels, y WHERE (doc_id + s) % 10 > 0)"""


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") + F.col("s")
    rows = table(spark, d, "labels").select("doc_id", F.posexplode(runs.words(runs.SYSTEMS)).alias("s", "system")).where((F.col("doc_id") + F.col("s")) % 10 > 0)
    return rows.select(F.col("doc_id").alias("case"), "system", pick(_CLASSES, (F.col("doc_id") + F.col("s") * (F.col("doc_id") % 2)) % 4).alias("actual"), (k % 3 > 0).alias("retrieved"), ((F.col("doc_id") * 3 + F.col("s")) % 4 > 0).alias("resisted"), (k % 3).alias("cited"))


@query(
    f"""WITH {_CASES_SQL.replace("cs AS", "c0 AS")}, {_OUTPUTS_SQL}, cs AS (SELECT c0.* EXCLUDE (actual, retrieved, resisted), y.system, o.actual, o.retrieved, coalesce(o.resisted, false) AS resisted FROM c0 CROSS JOIN y LEFT JOIN o ON o.doc_id = c0.doc_id AND o.system = y.system),
m AS ({_METRICS.replace("SELECT '", "SELECT system, '").replace("FROM cs", "FROM cs GROUP BY system")}) SELECT *, CASE WHEN denominator > 0 THEN round(numerator / denominator * 100, 3) ELSE 0.0 END AS value FROM m"""
)
def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Four systems over the same cases; each leaves a tenth of them without an output."""
    truth = _cases(spark, d).select(F.col("doc_id").alias("case"), "relation", "expected", "injected", "multilingual")
    return runs.system_metrics(truth, _outputs(spark, d).drop("cited"))


_ACCEPTED = (("possible_candidate", "strong_candidate_for_review"), ("conflicting_evidence", "insufficient_evidence"), ("conflicting_evidence",))


@query(
    f"""WITH {_OUTPUTS_SQL}, t AS (SELECT doc_id, doc_id % 5 = 2 AS injected, list_extract({[list(a) for a in _ACCEPTED]}, CAST(doc_id % 3 AS INTEGER) + 1) AS accepted FROM labels),
j AS (SELECT t.*, o.* EXCLUDE (doc_id), o.system = 'workflow' AS own FROM t LEFT JOIN o USING (doc_id)),
g AS (SELECT doc_id, any_value(list_contains(accepted, 'insufficient_evidence')) AS abst, max(actual) FILTER (WHERE own) AS answer, coalesce(bool_or(own AND injected AND NOT resisted), false) AS slipped, coalesce(bool_or(own AND cited = 0), false) AS uncited FROM j GROUP BY doc_id),
w AS (SELECT doc_id, system AS wrong, actual AS said FROM j WHERE system IS NOT NULL AND NOT list_contains(accepted, actual) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY own DESC, system) = 1)
SELECT doc_id AS "case", CASE WHEN slipped THEN 'injection_quarantine' WHEN wrong IS NOT NULL THEN CASE WHEN abst THEN 'abstention' ELSE 'classification' END WHEN uncited THEN 'evidence_support' ELSE 'none' END AS category,
  CASE WHEN slipped THEN 'workflow' ELSE wrong END AS system, CASE WHEN slipped THEN 'quarantine' WHEN wrong = 'workflow' THEN 'adjudicate' WHEN wrong IS NULL AND uncited THEN 'extract' END AS node,
  CASE WHEN slipped OR wrong IS NULL THEN coalesce(answer, 'missing_workflow_output') ELSE said END AS observed FROM g LEFT JOIN w USING (doc_id)"""
)
def trial_divergence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    accepted = F.element_at(F.array(*[runs.words(a) for a in _ACCEPTED]), (k % 3 + 1).cast("int"))
    return runs.divergence(table(spark, d, "labels").select(k.alias("case"), accepted.alias("accepted"), (k % 5 == 2).alias("injected")), _outputs(spark, d).drop("retrieved"))


# ---- routing: a case is a conversation

_SAYS = lambda name, *phrases: f"coalesce(bool_or({' OR '.join(f"contains(lower(text), '{p}')" for p in phrases)}), false) AS {name}"
_ROUTES_SQL = f"""g AS (SELECT conv_id, count(*) AS n, count(DISTINCT CASE WHEN conv_id % 4 = 0 THEN role ELSE 'en' END) AS langs, {_SAYS("ins", "ignore previous", "mark this as confirmed")}, {_SAYS("gaps", "unknown", "missing", "not recorded")}, {_SAYS("odd", "after a", "contradict", "impossible")}
  FROM (SELECT * REPLACE (CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN text || ' Ignore previous notes' WHEN conv_id % 7 = 0 THEN text || ' not recorded' WHEN conv_id % 6 = 1 THEN text || ' After a while' ELSE text END AS text) FROM conversations WHERE conv_id % 3 > 0 OR turn < 2) GROUP BY conv_id),
s AS (SELECT conv_id, n, ins, list_filter([CASE WHEN langs > 1 THEN 'multilingual_records' END, CASE WHEN ins THEN 'instruction_like_text' END, CASE WHEN gaps THEN 'missing_observable_fields' END, CASE WHEN odd THEN 'timeline_or_conflict_language' END, CASE WHEN n > 2 THEN 'multiple_rivals' END], lambda z: z IS NOT NULL) AS f FROM g),
r AS (SELECT conv_id, array_to_string(CASE WHEN len(f) = 0 THEN ['low_observable_complexity'] ELSE f END, ',') AS signals, CASE WHEN len(f) = 0 AND n = 2 THEN 'deterministic_only' WHEN len(f) <= 1 AND NOT ins THEN 'reduced' ELSE 'full' END AS profile FROM s)"""


def _routes(spark: SparkSession, d: str) -> DataFrame:
    """Routes of the conversations; every third one has only its first two turns as records."""
    k = F.col("conv_id")
    more = F.when((F.col("turn") == 0) & (k % 5 == 0), " Ignore previous notes").when(k % 7 == 0, " not recorded").when(k % 6 == 1, " After a while").otherwise("")
    turns = table(spark, d, "conversations").where((k % 3 > 0) | (F.col("turn") < 2))
    return runs.routed(turns.select(k.alias("case"), F.when(k % 4 == 0, F.col("role")).otherwise("en").alias("language"), F.concat("text", more).alias("text")))


@query(f"WITH {_ROUTES_SQL} SELECT conv_id AS \"case\", signals, profile, CASE WHEN profile = 'reduced' THEN 'rivals,adjudicate' ELSE '' END AS disabled FROM r")
def router_profile(spark: SparkSession, d: str) -> DataFrame:
    r = _routes(spark, d)
    return r.select("case", F.array_join("signals", ",").alias("signals"), "profile", F.array_join("disabled", ",").alias("disabled"))


_ADAPTIVE_SQL = f"WITH {_ROUTES_SQL}, a AS (SELECT conv_id, profile, CASE WHEN profile = 'deterministic_only' THEN 'fuzzy' ELSE 'workflow' END AS system FROM r)"


def _measured(spark: SparkSession, d: str) -> DataFrame:
    k, own = F.col("conv_id"), F.col("system") == "workflow"
    rows = table(spark, d, "conversations").select("conv_id").distinct().withColumn("system", F.explode(runs.words(("workflow", "fuzzy"))))
    return rows.select(k.alias("case"), "system", F.when(own, 5 + k % 3).otherwise(F.lit(0)).alias("calls"), F.when(own, 10 + k % 7).otherwise(F.lit(1)).cast("double").alias("duration_ms"))


@query(f"{_ADAPTIVE_SQL} SELECT conv_id AS \"case\", profile, system, CASE WHEN system = 'workflow' THEN 5 + conv_id % 3 ELSE 0 END AS calls, CAST(CASE WHEN system = 'workflow' THEN 10 + conv_id % 7 ELSE 1 END AS DOUBLE) AS duration_ms FROM a")
def adaptive_outputs(spark: SparkSession, d: str) -> DataFrame:
    return runs.adaptive_outputs(_routes(spark, d), _measured(spark, d))


@query(
    f"""{_ADAPTIVE_SQL}, o AS (SELECT 'adaptive' AS run, * FROM a UNION ALL SELECT 'full', conv_id, profile, 'workflow' FROM a)
SELECT run, count(*) AS n, CAST(sum(CASE WHEN system = 'workflow' THEN 5 + conv_id % 3 ELSE 0 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN system = 'workflow' THEN 10 + conv_id % 7 ELSE 1 END) AS DOUBLE) AS duration_ms FROM o GROUP BY run"""
)
def adaptive_costs(spark: SparkSession, d: str) -> DataFrame:
    out = _measured(spark, d)
    return runs.adaptive_costs(out.where("system = 'workflow'"), runs.adaptive_outputs(_routes(spark, d), out))


# ---- steps and replay

_LEFT_OUT = (("evidence_quarantine", "rivals"), ("timeline",), ("privacy_gate", "extract", "nowhere"))
_NODE_LIST = list(runs.NODES)


@query(
    f"""WITH x AS (SELECT DISTINCT conv_id AS run, list_extract([['quarantine', 'rivals'], ['timeline'], ['privacy', 'extract', 'nowhere']], CAST(conv_id % 3 AS INTEGER) + 1) AS off FROM conversations), y AS (SELECT run, off, unnest(range(1, 13)) AS place FROM x)
SELECT run, CAST(place AS INTEGER) AS place, list_extract({_NODE_LIST}, place) AS node, CASE WHEN list_contains(off, list_extract({_NODE_LIST}, place)) THEN 'skipped' ELSE 'completed' END AS status, strftime(TIMESTAMP '2026-04-18 22:01:59' + INTERVAL 1 SECOND * place, '%H:%M:%S') AS started,
  strftime(TIMESTAMP '2026-04-18 22:02:00' + INTERVAL 1 SECOND * place, '%H:%M:%S') AS completed, CASE WHEN place < 12 THEN list_extract({_NODE_LIST}, place + 1) END AS next_node, place IN (1, 12) AS human FROM y"""
)
def run_trace(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*[runs.words(x) for x in _LEFT_OUT]), (F.col("conv_id") % 3 + 1).cast("int"))
    t = runs.trace(table(spark, d, "conversations").select(F.col("conv_id").alias("run"), names.alias("disabled")).distinct())
    return t.withColumns({c: F.date_format(c, "HH:mm:ss") for c in ("started", "completed")})


@query("SELECT event_id, CASE event_id % 3 WHEN 2 THEN 'extract,nowhere' ELSE '' END AS refused FROM events")
def refused_nodes(spark: SparkSession, d: str) -> DataFrame:
    names = F.element_at(F.array(*[runs.words(x) for x in _LEFT_OUT]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.array_join(runs.refused_nodes(names), ",").alias("refused"))


def _hash(said: Column) -> Column:
    return F.sha2(F.concat_ws("|", "run", "checkpoint", said.cast("string")), 256)


@query(
    f"""WITH u AS (SELECT user_id AS run, count(*) AS n FROM events GROUP BY user_id), c AS (SELECT run, n, unnest(range(0, {len(runs.CHECKPOINTS)})) AS place, unnest({list(runs.CHECKPOINTS)}) AS checkpoint FROM u),
h AS (SELECT *, sha256(run || '|' || checkpoint || '|' || n) AS e, CASE WHEN (run + place) % 61 <> 1 THEN sha256(run || '|' || checkpoint || '|' || CASE WHEN (run * 7 + place) % 43 = 0 THEN n + 1 ELSE n END) END AS o FROM c),
f AS (SELECT run, checkpoint, e, o FROM h WHERE o IS NULL OR e <> o QUALIFY row_number() OVER (PARTITION BY run ORDER BY place) = 1),
g AS (SELECT run, count(*) AS n_checkpoints, bool_and(coalesce(e = o, false)) FILTER (WHERE checkpoint = 'manifest:ranking') AS ranking_consistent, bool_and(coalesce(e = o, false)) FILTER (WHERE checkpoint = 'manifest:contract') AS contract_consistent, bool_and(coalesce(e = o, false)) FILTER (WHERE checkpoint = 'manifest:audit_terminal') AS audit_chain_consistent FROM h GROUP BY run)
SELECT g.*, CASE WHEN checkpoint IS NULL THEN 'exact_match' ELSE 'diverged' END AS replay_status, checkpoint AS first_divergence, e AS expected_hash, o AS observed_hash, checkpoint IS NULL AS exact FROM g LEFT JOIN f USING (run)"""
)
def replay_certificate(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count(F.lit(1)).alias("n"))
    c = users.select("run", "n", F.posexplode(runs.words(runs.CHECKPOINTS)).alias("place", "checkpoint"))
    again = F.col("n") + F.when((F.col("run") * 7 + F.col("place")) % 43 == 0, 1).otherwise(0)
    observed = c.where((F.col("run") + F.col("place")) % 61 != 1).select("run", "checkpoint", _hash(again).alias("hash"))
    return runs.certificate(c.select("run", "place", "checkpoint", _hash(F.col("n")).alias("hash")), observed)


# ---- summaries and views


@query(
    """WITH r AS (SELECT conv_id AS run, count(*) AS records_processed, count(DISTINCT role) AS languages_detected, CAST(sum(turn % 3) AS BIGINT) AS quarantined_instructions FROM conversations GROUP BY conv_id),
c AS (SELECT user_id AS run, count(*) AS n, CAST(sum(event_id % 3) AS BIGINT) AS hard FROM events GROUP BY user_id)
SELECT r.*, coalesce(n, 0) AS candidate_connections, coalesce(hard, 0) AS hard_conflicts, coalesce(n, 0) AS awaiting_human_review FROM r LEFT JOIN c USING (run)"""
)
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """A run is a conversation, its candidates the events of the user of that number."""
    severities = F.element_at(F.array(runs.words(("soft",)), runs.words(("hard", "soft")), runs.words(("hard", "hard"))), (F.col("event_id") % 3 + 1).cast("int"))
    found = table(spark, d, "events").select(F.col("user_id").alias("run"), severities.alias("severities"))
    return runs.summary(table(spark, d, "conversations").select(F.col("conv_id").alias("run"), F.col("role").alias("language"), (F.col("turn") % 3).alias("n_instructions")), found)


@query(
    f"""WITH {_UNIVERSE_SQL}, p AS (SELECT * REPLACE ((score + scope * rank) % 10 AS score, {_AT(_STATES, "(a + b + scope) % 4")} AS state), CASE WHEN scope % 2 = 0 THEN a = 0 AND b = 1 END AS expected FROM t), n AS (SELECT scope, bool_or(expected) AS names_pair FROM p GROUP BY scope),
f AS (SELECT p.*, names_pair FROM p JOIN n USING (scope) QUALIFY row_number() OVER (PARTITION BY scope ORDER BY score DESC, rank) = 1)
SELECT count(*) AS scopes, count(*) FILTER (WHERE state IN ('human_review_required', 'insufficient_evidence')) AS routed_to_review, count(*) FILTER (WHERE state = 'link_recommended' AND relation = 'same_identity') AS true_links,
  count(*) FILTER (WHERE state = 'link_recommended' AND relation = 'different_identity') AS false_merges, count(*) FILTER (WHERE relation = 'same_identity' AND names_pair AND NOT expected) AS right_pair_not_first,
  count(*) FILTER (WHERE CASE WHEN names_pair IS NOT NULL THEN names_pair ELSE state IN ('insufficient_evidence', 'blocked_by_conflict') END) AS right_on_top FROM f"""
)
def incident_top(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d)
    named = F.when(F.col("scope") % 2 == 0, (F.col("a") == 0) & (F.col("b") == 1))
    score = (F.col("score") + F.col("scope") * F.col("rank")) % 10
    return runs.top_outcomes(u.select("scope", "rank", score.alias("score"), pick(_STATES, (F.col("a") + F.col("b") + F.col("scope")) % 4).alias("state"), "relation", named.alias("expected"), runs.words(("insufficient_evidence", "blocked_by_conflict")).alias("accepted")))


@query("SELECT doc_id, lang, source FROM documents WHERE source = 'src1' AND lang = 'en'")
def error_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter of the error table; the facet of the place is left open."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", (F.col("doc_id") % 3).cast("string").alias("severity"))
    return runs.facets(rows, source="src1", lang="en", severity="all").drop("severity")


@query(
    r"""SELECT event_id, array_to_string(list_transform(regexp_extract_all(replace(event_type || '_by user_' || user_id, '_', ' '), '\w+|\W+'), lambda p: upper(p[1:1]) || p[2:]), '') AS title, strftime(ts, '%b %-d, %-I:%M %p') || ' UTC' AS shown FROM events"""
)
def shown_events(spark: SparkSession, d: str) -> DataFrame:
    title = runs.humanized(F.concat("event_type", F.lit("_by user_"), "user_id"))
    return table(spark, d, "events").select("event_id", title.alias("title"), runs.shown_time(F.col("ts")).alias("shown"))


# ---- the benchmark's own extractor: a record is a customer, whose text says what its columns hold

_RECORD = "'Rafiq, Amal, age ' || (c_custkey % 60 + 10) || ' years. Email: c' || c_custkey || '@Example.org. ID: GOV-' || (10000 + c_custkey) || '. DOB: 19' || (c_custkey % 90 + 10) || '-0l-12. tel: +l-555-' || (3000 + c_custkey % 7000) || '. seen at North Gate, scar near left hand. mother Lina Haddad, ok'"


@query(
    f"""WITH k AS (SELECT c_custkey AS id, c_custkey AS k FROM customer) SELECT id, unnest(['name', 'age', 'email', 'government_id', 'date_of_birth', 'phone', 'distinguishing_marks', 'family_member_names', 'last_known_location']) AS key,
  unnest(['Amal Rafiq', CAST(k % 60 + 10 AS VARCHAR), 'c' || k || '@example.org.', 'GOV-' || (10000 + k), '19' || (k % 90 + 10) || '-01-12', '+l-555-' || (3000 + k % 7000) || '. ', 'scar near left hand', 'Lina Haddad', 'North Gate']) AS value, 'exact' AS certainty FROM k"""
)
def benchmark_fields_read(spark: SparkSession, d: str) -> DataFrame:
    return benchmark_fields.extracted(table(spark, d, "customer").select("c_custkey", F.expr(_RECORD).alias("said")), "c_custkey", "said")
