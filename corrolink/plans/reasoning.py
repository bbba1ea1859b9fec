"""Queries of claims, contracts, reasoning steps, retrieval evaluation and stores, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import claims, contracts, evaluate, reasoning, synth
from ..sources import stores
from .linkage import _CLOCK, _MINUTES
from .tables import COMPARED_SQL, DECIDED_SQL, compared_orders, decided_orders, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def pick(values: tuple, at) -> Column:
    """The value at a place that counts from 0."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


# ---- claims: a record is a document with three spans, a candidate two documents in a row

_FIELDS, _CERTAINTY = ("name", "Time", "location"), ("exact", "estimated", "translated", "inferred", "missing")
_SPANS_SQL = f"""sp AS (SELECT doc_id AS record, doc_id * 10 + j AS span, list_extract({list(_FIELDS)}, j + 1) AS field, substr(text, 5 * j + 1, 4) AS quote, 5 * j + CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS st,
  list_extract([3, 2, 2, 1, 0], CAST((doc_id + j) % 5 + 1 AS INTEGER)) AS rk, text, lang FROM documents, (SELECT unnest([0, 1, 2]) AS j)),
su AS (SELECT *, st + 4 <= len(text) AND substr(text, st + 1, 4) = quote AS sup FROM sp)"""


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    j = F.col("j")
    shift = F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    rows = docs.select("doc_id", "text", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    spans = rows.select(
        F.col("doc_id").alias("record"), (F.col("doc_id") * 10 + j).alias("span"), pick(_FIELDS, j).alias("field"), F.expr("substring(text, 5 * j + 1, 4)").alias("quote"),
        (5 * j + shift).alias("start"), (5 * j + shift + 4).alias("end"), pick(_CERTAINTY, (F.col("doc_id") + j) % 5).alias("certainty"),
    )
    return spans, docs.select(F.col("doc_id").alias("record"), F.col("text").alias("source_text"), F.col("lang").alias("language"))


@query(
    f"""WITH {_SPANS_SQL} SELECT span, lang AS language, sup AS supported, CASE WHEN sup THEN 'valid' ELSE 'invalid' END AS validation_status,
  sha256(CAST(to_json({{'end': st + 4, 'language': lang, 'quotation': quote, 'source_document_id': CAST(record AS VARCHAR), 'start': st}}) AS VARCHAR)) AS content_hash FROM su"""
)
def claim_spans(spark: SparkSession, d: str) -> DataFrame:
    return claims.span_support(*_spans(spark, d)).select("span", "language", "supported", "validation_status", "content_hash")


@query(
    f"""WITH {_SPANS_SQL}, c AS (SELECT doc_id // 2 AS candidate, doc_id AS a, doc_id + 1 AS b, doc_id % 3 = 0 AS tl FROM documents WHERE doc_id % 2 = 0 AND doc_id + 1 IN (SELECT doc_id FROM documents)),
rv AS (SELECT candidate, a + 2 AS record FROM c WHERE candidate % 3 = 0), near AS (SELECT candidate, a AS record FROM c UNION SELECT candidate, b FROM c UNION SELECT * FROM rv),
tm AS (SELECT candidate, span FROM c JOIN su ON su.record IN (c.a, c.b) AND lower(field) IN ('time', 'timeline', 'location')),
r0 AS (SELECT candidate, 'extracted_fact' AS t, CAST(span AS VARCHAR) AS d, span FROM near JOIN su USING (record)
  UNION ALL SELECT candidate, 'normalized_representation', CAST(record AS VARCHAR), span FROM near JOIN su USING (record) WHERE field = 'name'
  UNION ALL SELECT candidate, 'compatibility_claim', '1', unnest([a * 10, b * 10]) FROM c UNION ALL SELECT candidate, 'compatibility_claim', '2', NULL FROM c
  UNION ALL SELECT candidate, 'timeline_interpretation', 'timeline', span FROM c LEFT JOIN tm USING (candidate) WHERE tl
  UNION ALL SELECT candidate, 'contradiction_claim', CAST(candidate * 100 AS VARCHAR), CASE WHEN candidate % 7 > 0 THEN a * 10 + 1 END FROM c WHERE candidate % 5 = 0
  UNION ALL SELECT candidate, 'rival_comparison_claim', CAST(record AS VARCHAR), span FROM rv LEFT JOIN su USING (record)),
n AS (SELECT r0.*, su.sup, su.rk, 'CLAIM-' || upper(substr(sha256(candidate || '|' || t || '|' || d), 1, 12)) AS claim FROM r0 LEFT JOIN su USING (span)),
g AS (SELECT candidate, claim, t AS claim_type, count(span) AS n_spans, coalesce(bool_and(sup), true) AS supported, coalesce(min(rk), 1) AS rank FROM n GROUP BY ALL),
p AS (SELECT x.candidate, x.claim, string_agg(DISTINCT y.claim, ',' ORDER BY y.claim) AS parents FROM n x JOIN n y ON x.candidate = y.candidate AND x.span = y.span AND y.t = 'extracted_fact' AND x.t <> 'extracted_fact' GROUP BY 1, 2)
SELECT g.*, coalesce(parents, '') AS parents FROM g LEFT JOIN p USING (candidate, claim)"""
)
def claim_build(spark: SparkSession, d: str) -> DataFrame:
    spans, records = _spans(spark, d)
    ids = records.select("record")
    c = ids.where("record % 2 = 0").join(ids.select((F.col("record") - 1).alias("record")), "record").select(F.floor(F.col("record") / 2).alias("candidate"), F.col("record").alias("a"), (F.col("record") + 1).alias("b"), (F.col("record") % 3 == 0).alias("has_timeline"))
    factors = c.select("candidate", F.lit(1).alias("factor"), F.explode(F.array(F.col("a") * 10, F.col("b") * 10)).alias("span")).unionByName(c.select("candidate", F.lit(2).alias("factor"), F.lit(-1).cast("long").alias("span")))
    conflicts = c.where("candidate % 5 = 0").select("candidate", (F.col("candidate") * 100).alias("conflict"), F.when(F.col("candidate") % 7 > 0, F.array(F.col("a") * 10 + 1)).otherwise(F.array().cast("array<long>")).alias("spans"))
    rivals = c.where("candidate % 3 = 0").select("candidate", (F.col("a") + 2).alias("record"))
    fields = spans.where("field = 'name'").select("record", F.col("record").alias("field_id"), "span")
    told = claims.span_support(spans, records).withColumn("rank", contracts.rank(F.col("certainty")))
    return claims.built(claims.cited(c, spans, fields, factors, conflicts, rivals), told)


_CLASSES = ("strong_candidate_for_review", "insufficient_evidence", "conflicting_evidence", "possible_candidate")
_ROUTED = "CASE WHEN k % 9 = 0 THEN NULL WHEN k % 10 = 0 THEN 'possible_candidate' ELSE cl END"


@query(
    f"""WITH x AS (SELECT doc_id AS k, list_extract({list(_CLASSES)}, CAST(doc_id % 4 + 1 AS INTEGER)) AS cl FROM documents), y AS (SELECT *, {_ROUTED} AS ro, k % 3 = 0 AS hc, k % 3 = 0 AND k % 11 = 0 AS closed, cl = 'strong_candidate_for_review' AS strong FROM x)
SELECT k AS contract, unnest(list_filter([CASE WHEN hc AND (k % 5 = 0 OR k % 7 = 0) OR closed THEN 'EC-007' END, CASE WHEN strong AND k % 8 = 0 THEN 'EC-008' END, CASE WHEN k % 13 = 0 THEN 'EC-009' END,
  CASE WHEN ro IS NOT NULL AND (ro <> cl OR (hc AND cl <> 'conflicting_evidence') OR closed) THEN 'EC-012' END, CASE WHEN ro IS NOT NULL AND cl = 'insufficient_evidence' AND k % 3 = 0 THEN 'EC-013' END,
  CASE WHEN k % 17 = 0 THEN 'EC-014' END, CASE WHEN k % 19 = 0 THEN 'EC-015' END, CASE WHEN strong AND k % 6 < 2 THEN 'EC-016' END, CASE WHEN strong AND k % 5 = 0 THEN 'EC-017' END, CASE WHEN k % 23 = 0 THEN 'EC-018' END], lambda z: z IS NOT NULL)) AS rule FROM y"""
)
def contract_rules(spark: SparkSession, d: str) -> DataFrame:
    """The ten rules over contracts as a whole; each is violated by some document's contract."""
    k = F.col("k")
    some = lambda test, value: F.when(test, F.array(value)).otherwise(F.array().cast("array<long>"))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("k")).withColumn("cl", pick(_CLASSES, k % 4))
    rows = c.select(
        k.alias("contract"), F.col("cl").alias("classification"), F.expr(_ROUTED).alias("routed_classification"), some(k % 3 == 0, k).alias("hard_conflicts"), some(k % 5 > 0, k).alias("considered"), some(k % 7 > 0, k).alias("routed"),
        (k % 11 == 0).alias("block_conflicts"), some(k % 2 == 0, k + 1).alias("close_rivals"), some(k % 8 > 0, k + 1).alias("rivals"), F.when(k % 13 != 1, k % 13 > 0).alias("complete"), (k % 17 > 0).alias("chain_valid"),
        (k % 19 > 0).alias("replay_valid"), (k % 3).alias("n_abstentions"), (k % 6).alias("n_sources"), (k % 5).alias("n_critical"), (k % 23 > 0).alias("safety_notice"),
    )
    return contracts.contract_rules(rows).select("contract", "rule")


@query("SELECT doc_id AS \"case\", coalesce('C' || l.doc_id, 'NO-CANDIDATE') AS candidate, coalesce(CASE WHEN quality = 1 THEN 'possible_candidate' ELSE 'conflicting_evidence' END, '') AS classification FROM documents JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, 'NO-CANDIDATE', 'insufficient_evidence' FROM documents ANTI JOIN labels USING (doc_id)")
def contract_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "labels").select(F.col("doc_id").alias("case"), F.concat(F.lit("C"), F.col("doc_id")).alias("candidate"), F.when(F.col("quality") == 1, "possible_candidate").otherwise("conflicting_evidence").alias("classification"))
    return claims.with_fallback(table(spark, d, "documents").select(F.col("doc_id").alias("case")), found)


@query(
    """WITH k AS (SELECT l_orderkey AS cs, l_linenumber % 4 > 0 AS ok, CASE WHEN l_linenumber % 4 = 0 THEN 'EC-00' || (l_partkey % 9 + 1) END AS rule FROM lineitem),
g AS (SELECT cs, count(*) AS n, bool_and(ok) AS allowed, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule), '') AS rules FROM k GROUP BY cs), z AS (SELECT g.*, allowed AND o_orderstatus = 'F' AS released FROM g LEFT JOIN orders ON o_orderkey = cs)
SELECT cs AS "case", n AS n_contracts, CASE WHEN released THEN 'authorized_review_required' ELSE 'contract_blocked' END AS state, CASE WHEN released THEN '' ELSE rules END AS blocking_rules FROM z"""
)
def release_state(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("l_linenumber") % 4 > 0
    rules = F.when(ok, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("EC-00"), F.col("l_partkey") % 9 + 1)))
    held = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case"), ok.alias("released"), rules.alias("blocked_rules"))
    return claims.release_state(held, table(spark, d, "orders").select(F.col("o_orderkey").alias("case"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("broken").alias("status")))


# ---- reasoning over decided pairs

_CELLS = (("date_of_birth", "dc", "ds"), ("age", "ac", "ags"), ("government_id", "gc", "gs"), ("language", "lc", "ls"), ("last_known_location", "oc", "os"))
_ALL_CELLS = " UNION ALL ".join(f"SELECT scope, a, b, '{f}' AS field, {c} AS class, {s} AS value FROM d" for f, c, s in _CELLS)
_CELLS_SQL = COMPARED_SQL.replace("{review}", "0.15").replace("{link}", "0.35") + f", ce AS ({_ALL_CELLS})"
_STATUS = "CASE class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in reasoning.FACTOR_STATUS.items()) + " ELSE 'missing' END"


@query(f"WITH {_CELLS_SQL} SELECT scope, a, b, 'CF-' || upper(field) AS factor, field, {_STATUS} AS status, CASE WHEN class = 'strong_conflict' THEN 'CONFLICT-' || upper(field) END AS conflict FROM ce WHERE class NOT LIKE 'missing%'")
def factor_rows(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.factor_rows(compared_orders(spark, d), ["scope", "a", "b"])


@query(f"WITH {_CELLS_SQL} SELECT scope, a, b, field, value FROM ce WHERE value > 0 OR class LIKE 'missing%'")
def score_rows(spark: SparkSession, d: str) -> DataFrame:
    return reasoning.score_rows(compared_orders(spark, d), ["scope", "a", "b"])


@query(
    f"""WITH {DECIDED_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a, b) AS rank FROM dd), kept AS (SELECT * FROM rk WHERE rank <= 10),
met AS (SELECT p.scope, p.a || '-' || p.b AS candidate, o.a || '-' || o.b AS rival, p.score AS ps, o.score AS os, o.state AS state, row_number() OVER (PARTITION BY p.scope, p.rank ORDER BY o.rank) AS place FROM kept p JOIN kept o ON p.scope = o.scope AND p.rank <> o.rank)
SELECT scope, candidate, rival, CASE WHEN ps > os THEN 'stronger' WHEN ps < os THEN 'weaker' ELSE 'unresolved' END AS name, CASE WHEN state = 'blocked_by_conflict' THEN 'conflicting' ELSE 'unresolved' END AS hard FROM met WHERE place <= 5"""
)
def rival_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Rivals of the ten candidates that a scope's retrieval cap lets through."""
    ranked = decided_orders(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy("a", "b"))).where("rank <= 10")
    return reasoning.rivals(ranked.select("scope", F.concat_ws("-", "a", "b").alias("candidate"), "rank", F.col("score").alias("name_score"), (F.col("state") == "blocked_by_conflict").alias("blocked")), 5)


@query("SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN false ELSE doc_id % 4 < 3 END AS cites_valid FROM documents")
def hypothesis_citations(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    cited = F.when(k % 6 == 0, F.array().cast("array<long>")).otherwise(F.array(k * 10, k * 10 + k % 4))
    return table(spark, d, "documents").select("doc_id", reasoning.cites_valid(cited, F.array(k * 10, k * 10 + 1, k * 10 + 2)).alias("cites_valid"))


_BLOCKING = "array_remove(array(CASE WHEN doc_id % 2 = 0 THEN 'government_id' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'age' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN 'date_of_birth' ELSE '' END), '')"
_REPORTED = "array_remove(array(CASE WHEN doc_id % 6 = 0 THEN 'age' ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN 'clothing' ELSE '' END), '')"
_AS_LISTS = """z AS (SELECT doc_id, list_filter([CASE WHEN doc_id % 2 = 0 THEN 'government_id' END, CASE WHEN doc_id % 3 = 0 THEN 'age' END, CASE WHEN doc_id % 5 = 0 THEN 'date_of_birth' END], lambda x: x IS NOT NULL) AS bl,
  list_filter([CASE WHEN doc_id % 6 = 0 THEN 'age' END, CASE WHEN doc_id % 4 = 0 THEN 'clothing' END], lambda x: x IS NOT NULL) AS re FROM documents)"""


@query(f"WITH {_AS_LISTS} SELECT doc_id, array_to_string(list_concat(re, list_sort(list_filter(bl, lambda x: NOT list_contains(re, x)))), ',') AS conflicts FROM z")
def conflicts_restored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(reasoning.restored(F.expr(_BLOCKING), F.expr(_REPORTED)), ",").alias("conflicts"))


@query(f"WITH {_AS_LISTS} SELECT doc_id, array_to_string(list_sort(list_filter(re, lambda x: NOT list_contains(bl, x))), ',') AS triggered, array_to_string(list_sort(list_filter(bl, lambda x: NOT list_contains(re, x))), ',') AS resolved FROM z")
def rule_changes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "documents").select("doc_id", reasoning.rule_changes(F.expr(_BLOCKING), F.expr(_REPORTED)).alias("c"))
    return c.select("doc_id", F.array_join("c.triggered", ",").alias("triggered"), F.array_join("c.resolved", ",").alias("resolved"))


@query(
    f"""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 1 THEN NULL ELSE {_MINUTES} END AS m FROM events), n AS (SELECT *, lead(m) OVER w AS m2, lead(event_id) OVER w AS after FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, after, coalesce(m2 >= m OR abs(m2 - m) <= 30, true) AS passes FROM n WHERE after IS NOT NULL"""
)
def timeline_compatibility(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("event_id") % 4 == 1, "nobody saw them").otherwise(F.concat(F.lit("they were seen around "), F.expr(_CLOCK.replace("VARCHAR", "STRING")), F.lit(" that day")))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", said.alias("t")).withColumn("t2", F.lead("t").over(w)).withColumn("after", F.lead("event_id").over(w))
    return e.where("after is not null").select("event_id", "after", reasoning.timeline_compatible(F.col("t"), F.col("t2")).alias("passes"))


_KEY = "CASE c_custkey % 3 WHEN 0 THEN 'phone' WHEN 1 THEN 'date_of_birth' ELSE 'name' END"
_VALUE = "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '+44 20 7946' WHEN 3 THEN '1990-05' WHEN 4 THEN ' Amal Haddad' WHEN 5 THEN 'nowhere' ELSE '442079' END"
_EXPECTED = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '44 207946' WHEN 2 THEN '1990-05-17' WHEN 3 THEN 'amal haddad' ELSE 'other' END"
_SOURCE = "'Amal Haddad, born 1990-05-17, call +44 20 7946'"


@query(
    f"""WITH x AS (SELECT c_custkey, {_KEY} AS k, {_VALUE} AS raw, {_EXPECTED} AS want, lower({_SOURCE}) AS t FROM customer), y AS (SELECT *, lower(trim(raw)) AS v, coalesce(lower(trim(want)), '') AS e FROM x),
z AS (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS dv, regexp_replace(e, '[^0-9]', '', 'g') AS de FROM y)
SELECT c_custkey, CASE WHEN raw IS NULL OR raw = '' THEN 'omitted' WHEN e = '' AND v <> '' AND NOT contains(t, v) THEN 'hallucinated' WHEN e = '' OR v = e THEN 'exact_match' WHEN k = 'phone' AND dv = de AND len(dv) >= 7 THEN 'normalization_equivalent'
  WHEN k = 'date_of_birth' AND (contains(e, v) OR contains(v, e)) THEN 'partial_usable' WHEN contains(t, v) THEN 'exact_match' ELSE 'incorrect' END AS fidelity FROM z"""
)
def value_fidelity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", reasoning.value_fidelity(F.expr(_KEY), F.expr(_VALUE), F.expr(_EXPECTED), F.expr(_SOURCE)).alias("fidelity"))


# ---- the universe of pairs: an incident is a conversation, its records are the turns

_STATES = ("link_recommended", "human_review_required", "insufficient_evidence", "blocked_by_conflict")
_RELATION = "CASE (a + b) % 3 WHEN 0 THEN 'same_identity' WHEN 1 THEN 'different_identity' ELSE 'genuinely_ambiguous' END"
_UNIVERSE_SQL = f"""u AS (SELECT x.conv_id AS scope, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn), t AS (SELECT *, {_RELATION} AS relation, (a * 7 + b * 3) % 10 AS score,
  row_number() OVER (PARTITION BY scope ORDER BY a, b) AS rank, list_extract({list(_STATES)}, CAST((a + b) % 4 + 1 AS INTEGER)) AS state FROM u)"""


def _universe(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    u = reasoning.universe(table(spark, d, "conversations"), "conv_id", "turn", "turn")
    return u.select("scope", "a", "b", F.expr(_RELATION).alias("relation"), ((a * 7 + b * 3) % 10).alias("score"), F.row_number().over(Window.partitionBy("scope").orderBy("a", "b")).alias("rank"), pick(_STATES, (a + b) % 4).alias("state"))


@query(f"WITH {_UNIVERSE_SQL} SELECT scope, a, b, relation FROM t")
def universe_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _universe(spark, d).select("scope", "a", "b", "relation")


@query(f"WITH {_UNIVERSE_SQL} SELECT scope, a, b FROM t WHERE relation = 'same_identity' AND b - a > 2")
def not_retrieved(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d)
    return reasoning.not_retrieved(u, u.where("b - a <= 2").select("scope", F.col("b").alias("a"), F.col("a").alias("b")))


@query(f"WITH {_UNIVERSE_SQL} SELECT scope, a, b, score, place FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, a, b) AS place FROM t) WHERE place <= 3")
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The three best pairs of each incident; place 1 is its decision."""
    return reasoning.best_by_score(_universe(spark, d), 3).select("scope", "a", "b", "score", "place")


@query(
    f"""WITH {_UNIVERSE_SQL} SELECT scope, a, b, rank, CASE WHEN rank <= 4 THEN rank END AS final_rank, a % 3 = 1 AS mandatory, rank <= 4 AS retained, CASE WHEN rank > 4 THEN CASE WHEN a % 3 = 1 THEN 'unexpected_strong_removal' ELSE 'cap_non_mandatory' END END AS removal_reason,
  CASE WHEN a = 0 THEN 'unlabeled' ELSE relation END AS relation, b % 4 > 0 AS evaluated, CASE WHEN b % 4 > 0 THEN state END AS state, CASE WHEN b % 4 > 0 THEN round(score / 7, 4) END AS score FROM t"""
)
def candidate_artifact(spark: SparkSession, d: str) -> DataFrame:
    u = _universe(spark, d)
    final, decided = u.where("rank <= 4").withColumn("final_rank", F.col("rank")), u.where("b % 4 > 0").withColumn("score", F.col("score") / 7)
    return reasoning.artifact(u.select("scope", "a", "b", "rank", (F.col("a") % 3 == 1).alias("mandatory")), final, u.where("a <> 0"), decided)


_RECALLS = {"retrieved": "b - a <= 3", "kept": "b - a <= 3 AND rank <= 6", "open": "b - a <= 3 AND rank <= 6 AND state IN ('link_recommended', 'human_review_required')", "recommended": "b - a <= 3 AND rank <= 6 AND state = 'link_recommended'"}


@query(
    f"""WITH {_UNIVERSE_SQL}, g AS (SELECT count(*) FILTER (WHERE relation = 'same_identity') AS same, count(*) FILTER (WHERE relation = 'different_identity') AS different,
{", ".join(f"count(*) FILTER (WHERE relation = 'same_identity' AND {c}) AS {k}" for k, c in _RECALLS.items())}, count(*) FILTER (WHERE relation = 'different_identity' AND {_RECALLS["recommended"]}) AS false_merges,
count(*) FILTER (WHERE NOT ({_RECALLS["kept"]})) AS not_evaluated, count(*) AS universe FROM t) SELECT *, {", ".join(f"round({k} / same, 6) AS recall_{k}" for k in _RECALLS)}, round(false_merges / different, 6) AS false_merge_rate FROM g"""
)
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.retrieval_metrics(_universe(spark, d).select("relation", "state", F.expr(_RECALLS["retrieved"]).alias("retrieved"), F.expr(_RECALLS["kept"]).alias("final")))


@query(
    f"""WITH {_UNIVERSE_SQL}, p AS (SELECT *, CASE WHEN scope % 3 = 0 THEN 'blocked_by_conflict' ELSE 'do_not_link' END AS expected FROM t),
g AS (SELECT unnest([{{'invariant': 'blocked_cannot_be_upgraded', 'offending': count(*) FILTER (WHERE expected = 'blocked_by_conflict' AND state = 'link_recommended')}},
 {{'invariant': 'common_name_only_not_recommended', 'offending': count(*) FILTER (WHERE scope % 5 = 0 AND state = 'link_recommended')}}, {{'invariant': 'unique_id_survives_caps', 'offending': count(*) FILTER (WHERE a % 2 = 0 AND relation = 'same_identity' AND rank > 4)}},
 {{'invariant': 'audit_no_sensitive_values', 'offending': 0}}, {{'invariant': 'recommended_has_evidence', 'offending': count(*) FILTER (WHERE state = 'link_recommended' AND score < 3)}}, {{'invariant': 'blocking_has_policy_ids', 'offending': 0}}], recursive := true) FROM p)
SELECT *, offending = 0 AS holds FROM g"""
)
def safety_invariants(spark: SparkSession, d: str) -> DataFrame:
    scope, state = F.col("scope"), F.col("state")
    held = lambda test: F.when(test, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return evaluate.invariants(_universe(spark, d).select(
        F.concat(F.when(scope % 5 == 0, "INC-COMMON-").otherwise("INC-"), scope).alias("incident"), F.when(scope % 3 == 0, "blocked_by_conflict").otherwise("do_not_link").alias("expected"), "state",
        held(F.col("score") >= 3).alias("supporting"), held(state == "blocked_by_conflict").alias("blocking"), (F.col("a") % 2 == 0).alias("unique_id"), (F.col("relation") == "same_identity").alias("same"), (F.col("rank") <= 4).alias("retained"),
    ))


# ---- metrics of systems and splits


@query(
    """WITH s AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(sum(event_id % 97) AS DOUBLE) AS ms, CAST(sum(event_id % 7) AS DOUBLE) AS calls, CAST(sum(CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS failures, CAST(sum(event_id % 2) AS DOUBLE) AS retries,
  CAST(sum(event_id % 5) AS DOUBLE) AS cited, CAST(sum(CASE WHEN event_id % 5 > 1 THEN event_id % 5 - 1 ELSE 0 END) AS DOUBLE) AS faithful FROM events)
SELECT 'evidence_faithfulness' AS metric_id, faithful AS numerator, cited AS denominator, round(faithful / cited * 100, 3) AS value FROM s UNION ALL SELECT 'average_duration_ms', ms, n, round(ms / n, 3) FROM s
UNION ALL SELECT 'model_calls', calls, 1, calls FROM s UNION ALL SELECT 'failures', failures, 1, failures FROM s UNION ALL SELECT 'retries', retries, 1, retries FROM s"""
)
def operating_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return evaluate.operating_metrics(table(spark, d, "events").select((e % 97).alias("duration_ms"), (e % 7).alias("calls"), F.when(e % 50 == 0, 1).otherwise(0).alias("failures"), (e % 2).alias("retries"), (e % 5).alias("cited"), F.greatest(e % 5 - 1, F.lit(0)).alias("faithful")))


_SPLIT = {"relation": _RELATION.replace("(a + b)", "o_orderkey"), "positive": "o_orderkey % 4 < 2", "pair_right": "o_orderkey % 5 > 0", "released": "o_orderkey % 7 < 3", "human_review": "o_orderkey % 11 > 0", "replayed": "o_orderkey % 13 > 0", "audited": "o_orderkey % 17 > 0", "critical": "o_orderkey % 3 > 0"}
_RATIOS = {
    "top1_recall": ("relation = 'same_identity'", "positive AND pair_right"), "top1_precision_among_releases": ("released AND positive", "relation = 'same_identity'"), "different_identity_withheld": ("relation = 'different_identity'", "NOT (released AND positive)"),
    "same_identity_withheld": ("relation = 'same_identity'", "NOT released"), "human_review": ("true", "human_review"), "replay_success": ("true", "replayed"), "audit_verification": ("true", "audited"), "record_removal_change": ("true", "critical"),
}


@query(
    f"""WITH x AS (SELECT o_orderstatus AS split, {", ".join(f"{v} AS {k}" for k, v in _SPLIT.items())}, o_orderkey % 10 AS rule FROM orders), g AS ({" UNION ALL ".join(f"SELECT split, '{k}' AS metric_id, count(*) FILTER (WHERE {of} AND {hit}) AS numerator, count(*) FILTER (WHERE {of}) AS denominator FROM x GROUP BY split" for k, (of, hit) in _RATIOS.items())}
UNION ALL SELECT split, 'contract_rule_coverage', count(DISTINCT rule), 18 FROM x GROUP BY split) SELECT *, CASE WHEN denominator > 0 THEN round(numerator / denominator * 100, 3) ELSE 0 END AS value FROM g"""
)
def holdout_metrics(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array(F.concat(F.lit("EC-"), F.col("o_orderkey") % 10))
    return evaluate.holdout_metrics(table(spark, d, "orders").select(F.col("o_orderstatus").alias("split"), *[F.expr(v).alias(k) for k, v in _SPLIT.items()], rules.alias("rules"), F.lit(18).alias("n_rules")))


@query("WITH c AS (SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source) SELECT *, round(n / sum(n) OVER (PARTITION BY dimension), 6) AS share FROM c")
def dataset_composition(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.composition(table(spark, d, "documents"), ["lang", "source"])


# ---- stores and views


@query("SELECT user_id AS run, max(event_id) AS sequence, arg_max(event_type, event_id) AS event_hash FROM events GROUP BY user_id")
def chain_tail(spark: SparkSession, d: str) -> DataFrame:
    return stores.chain_tail(table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("sequence"), F.col("event_type").alias("event_hash"))).select("run", "sequence", "event_hash")


@query("SELECT user_id AS run, event_id, event_type FROM events WHERE user_id % 4 > 0 UNION ALL SELECT user_id, event_id + 1000000, 'again' FROM events WHERE user_id % 4 = 0")
def replaced_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), "event_id", "event_type")
    return stores.replaced_runs(e, e.where("run % 4 = 0").select("run", (F.col("event_id") + 1000000).alias("event_id"), F.lit("again").alias("event_type")))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'ID' || doc_id END AS identity, toxic = 1 AS under FROM documents JOIN labels USING (doc_id) WHERE (quality = 1) = (toxic = 1)")
def unassigned_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose labels give an identity and under-specification both or neither."""
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    truth = joined.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("ID"), "doc_id")).alias("identity"), (F.col("toxic") == 1).alias("under"))
    return stores.unassigned(truth, "identity", "under")


_LABEL = "list_extract(['Confirmed Match', 'identity confirmed', 'PERSON_FOUND', 'possible match', 'no confirmed match', NULL], CAST(doc_id % 6 + 1 AS INTEGER))"


@query(f"SELECT doc_id, {_LABEL} AS label FROM documents WHERE doc_id % 6 < 3")
def prohibited_labels(spark: SparkSession, d: str) -> DataFrame:
    label = pick(("Confirmed Match", "identity confirmed", "PERSON_FOUND", "possible match", "no confirmed match", None), F.col("doc_id") % 6)
    return stores.prohibited(table(spark, d, "documents").select("doc_id", label.alias("label")), "label")


@query("SELECT conv_id, turn, role FROM conversations SEMI JOIN (SELECT doc_id AS conv_id FROM labels WHERE quality = 1) USING (conv_id)")
def scenario_records(spark: SparkSession, d: str) -> DataFrame:
    """The turns of the conversations that a case list names."""
    named = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("conv_id"))
    return stores.scenario(table(spark, d, "conversations").select("conv_id", "turn", "role"), named, "conv_id")


@query("SELECT DISTINCT lang FROM documents")
def distinct_languages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang").distinct()


@query("SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events WHERE event_type IN ('error', 'purchase') OR contains(lower(props), 'mobile')")
def audit_filter(spark: SparkSession, d: str) -> DataFrame:
    """The audit view: events of some kinds, or whose details hold a word, with the minute shown."""
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase") | F.contains(F.lower("props"), F.lit("mobile")))
    return e.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("shown"))


# ---- trials: a record is a supplier; counterfactuals: a scope is four documents

_TRIAL = {
    "record_id": "'S' || s_suppkey", "display_name": "CASE s_suppkey % 3 WHEN 0 THEN 'Youssef Hassan' WHEN 1 THEN 'Mina Darzi' END",
    "text": "'Youssef, age 14, blue coat, slight limp, seen at Al Noor School by ' || s_name", "translated_text": "CASE WHEN s_suppkey % 2 = 0 THEN 'a limp' END", "reliability": "CASE WHEN s_suppkey % 5 > 0 THEN 'first hand' END",
}
_NAME_OF = "coalesce(display_name, 'Unknown')"
_EDITS = {
    "transliteration_corruption": {"display_name": "replace(display_name, 'Youssef', 'Yosef')", "text": "replace(text, 'Youssef', 'Yosef')"},
    "spelling_corruption": {"display_name": f"substr({_NAME_OF}, 1, greatest(1, len({_NAME_OF}) // 2)) || substr({_NAME_OF}, greatest(1, len({_NAME_OF}) // 2) + 2)"},
    "missing_surname": {"display_name": f"string_split({_NAME_OF}, ' ')[1]"},
    "estimated_age_shift": {"text": "replace(text, '14', list_extract(['11', '12', '16', '17'], CAST(('0x' || substr(md5('41027|' || record_id), 1, 4))::INTEGER % 4 + 1 AS INTEGER)))"},
    "missing_location": {"text": f"replace(text, '{synth.PLACE_FROM}', '{synth.PLACE_MISSING}')"},
    "changed_location": {"text": f"replace(text, '{synth.PLACE_FROM}', '{synth.PLACE_TO}')"},
    "conflicting_distinctive_feature": {"text": f"replace(text, '{synth.FEATURE_FROM}', '{synth.FEATURE_TO}')"},
    "translation_detail_loss": {"translated_text": f"replace(translated_text, 'limp', '{synth.DETAIL_TO}')", "text": f"CASE WHEN translated_text IS NULL THEN replace(text, 'limp', '{synth.DETAIL_TO}') ELSE text END"},
    "source_reliability_noise": {"reliability": f"'{synth.NOISE}'"},
    **{k: {"text": f"text || ' {v}'"} for k, v in synth.ADDED.items()},
    **{k: {"record_id": f"record_id || '-{v}-1'", **({"reliability": f"'{synth.RIVAL_NOTE}'"} if v != "DUP" else {})} for k, v in synth.COPIES.items()},
}
_TRIAL_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS mutation, r.record_id AS old_record_id, r.display_name AS old_display_name, r.text AS old_text, r.translated_text AS old_translated_text, r.reliability AS old_reliability, {', '.join(f'{e.get(c, c)} AS {c}' for c in _TRIAL)} FROM r" for m, e in _EDITS.items())


@query(
    f"""WITH r AS (SELECT {", ".join(f"{v} AS {k}" for k, v in _TRIAL.items())} FROM supplier), x AS ({_TRIAL_ROWS})
SELECT mutation, {", ".join(_TRIAL)}, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} IS DISTINCT FROM old_{c} THEN '{c}' END" for c in _TRIAL)}], lambda z: z IS NOT NULL), ',') AS affected FROM x"""
)
def trial_mutations(spark: SparkSession, d: str) -> DataFrame:
    return synth.trial_mutated(table(spark, d, "supplier").select(*[F.expr(v.replace("'S' || s_suppkey", "concat('S', s_suppkey)")).alias(k) for k, v in _TRIAL.items()]), 41027)


_KINDS = ("remove_source_record", "mark_source_unavailable", "reduce_evidence_certainty", "remove_compatibility_claim")


@query(
    f"""WITH x AS (SELECT doc_id // 4 AS cf, doc_id AS record_id, text, list_extract({list(_KINDS)}, CAST(doc_id // 4 % 4 + 1 AS INTEGER)) AS kind, doc_id % 4 = 1 AND length(text) >= 12 AS hit FROM documents)
SELECT cf AS counterfactual, record_id, CASE WHEN NOT hit THEN text WHEN kind = 'mark_source_unavailable' THEN '{synth.UNAVAILABLE}'
  WHEN kind = 'reduce_evidence_certainty' THEN substr(text, 1, 2) || 'approximately ' || substr(text, 3, 6) || 'approximately ' || substr(text, 9)
  ELSE substr(text, 1, 2) || '{synth.UNAVAILABLE}' || substr(text, 7, 2) || '{synth.UNAVAILABLE}' || substr(text, 13) END AS text
FROM x WHERE NOT (hit AND kind = 'remove_source_record') AND cf IN (SELECT cf FROM x WHERE hit)"""
)
def counterfactual_records(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("scope"), F.col("doc_id").alias("record_id"), "text")
    spot = F.explode(F.array(F.struct(F.lit(2).alias("start"), F.lit(6).alias("end")), F.struct(F.lit(8).alias("start"), F.lit(12).alias("end"))))
    changes = docs.where("record_id % 4 = 1 and length(text) >= 12").select(F.col("scope").alias("counterfactual"), pick(_KINDS, F.col("scope") % 4).alias("kind"), "record_id", spot.alias("s"))
    return synth.counterfactual_records(docs, changes.select("counterfactual", "kind", "record_id", "s.start", "s.end"))
