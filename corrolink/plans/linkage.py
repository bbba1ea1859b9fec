"""Queries of blocking, comparison and decision, each with its SQL."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, phone, policy, text
from ..operators import blocking, compare, decide
from .tables import COMPARED_SQL, DECIDED_SQL, EMITTED_SQL, POLICY, compared_orders, customer_keys, dealt, decided_orders, pairs_within, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def joined_rules() -> Column:
    return F.array_join("rules", ",").alias("rules")


@query(f"WITH {EMITTED_SQL} SELECT scope, a, b, array_to_string(rules, ',') AS rules FROM p")
def blocking_pairs(spark: SparkSession, d: str) -> DataFrame:
    return blocking.pairs(blocking.emissions(customer_keys(spark, d))).select("scope", "a", "b", joined_rules())


@query(
    f"""WITH {EMITTED_SQL}, q AS (SELECT scope, a, b, count(DISTINCT rule) AS n_rules, count(*) AS n FROM e GROUP BY scope, a, b)
SELECT rule, count(*) AS n FROM e GROUP BY rule UNION ALL SELECT 'raw_pairs', CAST(coalesce(sum(n), 0) AS BIGINT) FROM q UNION ALL SELECT 'unique_pairs', count(*) FROM q
UNION ALL SELECT 'duplicates', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM q UNION ALL SELECT 'multi_rule', count(*) FILTER (WHERE n_rules > 1) FROM q"""
)
def blocking_rule_stats(spark: SparkSession, d: str) -> DataFrame:
    return blocking.emission_stats(blocking.emissions(customer_keys(spark, d)))


_CAPPED_SQL = """
cp AS (SELECT *, list_contains(rules, 'government_id') AS mandatory FROM p),
ck AS (SELECT *, row_number() OVER (PARTITION BY scope, mandatory ORDER BY len(rules) DESC, a, b) AS place FROM cp),
cr AS (SELECT scope, a, b, rules, mandatory, row_number() OVER (PARTITION BY scope ORDER BY len(rules) DESC, a, b) AS rank FROM ck WHERE mandatory OR place <= 30)"""


def _capped(spark: SparkSession, d: str) -> DataFrame:
    return blocking.capped(blocking.pairs(blocking.emissions(customer_keys(spark, d))), 30)


@query(f"WITH {EMITTED_SQL}, {_CAPPED_SQL} SELECT scope, a, b, array_to_string(rules, ',') AS rules, mandatory, rank FROM cr")
def block_cap_mandatory(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).select("scope", "a", "b", joined_rules(), "mandatory", "rank")


@query(
    f"""WITH {EMITTED_SQL}, {_CAPPED_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY CASE WHEN list_contains(rules, 'government_id') THEN 0 ELSE 1 END, rank) AS final_rank FROM cr)
SELECT scope, a, b, rank, final_rank FROM f WHERE final_rank <= 10"""
)
def retrieval_recap(spark: SparkSession, d: str) -> DataFrame:
    return blocking.recapped(_capped(spark, d), 10).select("scope", "a", "b", "rank", "final_rank")


_REGION = "SELECT s_nationkey * 100 + s_suppkey // 20 AS scope, s_suppkey AS record, CAST(s_suppkey % 3 AS VARCHAR) AS k, CASE WHEN s_suppkey % 4 = 0 THEN 'E' || (s_suppkey % 8) END AS m FROM supplier"


@query(
    f"""WITH r AS ({_REGION}), k AS (SELECT scope, record, 'email_exact' AS rule, m AS key FROM r WHERE m IS NOT NULL UNION ALL SELECT scope, record, 'family_member_plus_location', k FROM r),
e AS (SELECT DISTINCT x.scope, x.record AS a, y.record AS b FROM k x JOIN k y ON x.scope = y.scope AND x.rule = y.rule AND x.key = y.key AND x.record < y.record),
n AS (SELECT scope FROM r GROUP BY scope HAVING count(*) <= 20), g AS (SELECT scope FROM e SEMI JOIN n USING (scope) GROUP BY scope HAVING count(*) BETWEEN 2 AND 60),
f AS (SELECT e.* FROM e SEMI JOIN g USING (scope)), u AS (SELECT scope, a AS x, b AS y FROM f UNION ALL SELECT scope, b, a FROM f),
h AS (SELECT l.scope, l.x AS a, r.y AS b, l.y AS mid FROM u l JOIN u r ON l.scope = r.scope AND l.y = r.x AND l.x < r.y),
w AS (SELECT h.* FROM h ANTI JOIN e USING (scope, a, b)), z AS (SELECT scope, a, b, array_to_string(list_sort(list(DISTINCT mid)), ',') AS via FROM w GROUP BY scope, a, b)
SELECT scope, a, b, via FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a, b) AS place FROM z) WHERE place <= 100"""
)
def two_hop_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("scope", F.col("s_nationkey") * 100 + F.floor(F.col("s_suppkey") / 20))
    keys = {"email_exact": F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("E"), F.col("s_suppkey") % 8)), "family_member_plus_location": (F.col("s_suppkey") % 3).cast("string")}
    found = blocking.pairs(blocking.emissions(blocking.key_table(s, keys, "scope", "s_suppkey")))
    sizes = s.groupBy("scope").agg(F.count(F.lit(1)).alias("n_records"))
    return blocking.two_hop(found, sizes).select("scope", "a", "b", F.array_join("via", ",").alias("via"))


@query(
    """WITH r AS (SELECT s_nationkey * 100 + s_suppkey // 20 AS scope, s_suppkey AS record, 'N' || (s_suppkey % CASE WHEN s_nationkey % 2 = 0 THEN 3 ELSE 1000000 END) AS name FROM supplier),
p AS (SELECT DISTINCT x.scope FROM r x JOIN r y ON x.scope = y.scope AND x.record < y.record AND x.record % 11 = y.record % 11),
bare AS (SELECT r.* FROM r ANTI JOIN p USING (scope)),
n AS (SELECT x.scope, x.record AS a, y.record AS b, 'fallback_name' AS rule FROM bare x JOIN bare y ON x.scope = y.scope AND x.name = y.name AND x.record < y.record),
s AS (SELECT bare.* FROM bare ANTI JOIN n USING (scope)), k AS (SELECT scope FROM s GROUP BY scope HAVING count(*) <= 8), z AS (SELECT s.* FROM s SEMI JOIN k USING (scope))
SELECT * FROM n UNION ALL SELECT x.scope, x.record, y.record, 'fallback_all' FROM z x JOIN z y ON x.scope = y.scope AND x.record < y.record"""
)
def fallback_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    r = s.select((F.col("s_nationkey") * 100 + F.floor(F.col("s_suppkey") / 20)).alias("scope"), F.col("s_suppkey").alias("record"), F.concat(F.lit("N"), F.col("s_suppkey") % F.when(F.col("s_nationkey") % 2 == 0, 3).otherwise(1000000), F.lit(" x")).alias("name"))
    found = blocking.pairs(blocking.emissions(blocking.key_table(r, {"phone_suffix": (F.col("record") % 11).cast("string")}, "scope", "record")))
    return blocking.fallback_pairs(r, found)


@query("WITH r AS (SELECT c_nationkey AS scope, count(*) AS n FROM customer GROUP BY 1), " + EMITTED_SQL.replace("r AS (", "r0 AS (").replace("FROM r ", "FROM r0 ").replace("FROM r)", "FROM r0)") + " SELECT scope, n AS n_records, count(a) AS n_candidates, count(a) / (n * (n - 1) / 2) AS reduction FROM r LEFT JOIN p USING (scope) GROUP BY scope, n HAVING n > 1")
def reduction_ratio(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("scope")).agg(F.count(F.lit(1)).alias("n_records")).where("n_records > 1")
    found = blocking.pairs(blocking.emissions(customer_keys(spark, d))).groupBy("scope").agg(F.count(F.lit(1)).alias("n_candidates"))
    return sizes.join(found, "scope", "left").fillna(0, ["n_candidates"]).withColumn("reduction", blocking.reduction(F.col("n_records"), F.col("n_candidates")))


# ---- phones


_PHONE_TEXT = {
    0: "'+44 20 7946 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')", 1: "'0044 (20) 7946-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')", 2: "'20 7946 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')",
    3: "'555 010 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') || ' ext. 12'", 4: "'+999 12 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')", 5: "'55 ' || (c_custkey % 100)",
    6: "'call 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')", 7: "'00123'", 8: "'box 12 x 3'",
}
PHONE_TEXT = "CASE c_custkey % 9 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _PHONE_TEXT.items()) + " END"
SPARK_PHONE_TEXT = PHONE_TEXT.replace("VARCHAR", "STRING")
_CODES = ", ".join(f"'{c}'" for c in phone.calling_codes())
PHONE_SQL = rf"""
p0 AS (SELECT c_custkey, c_nationkey, {PHONE_TEXT} AS raw FROM customer),
p1 AS (SELECT *, regexp_extract(raw, '(?i)(?:\s+|^)(ext\.?|extension|poste|x)\s*(\d{{1,6}})\s*$', 1) AS marker, regexp_extract(raw, '(?i)(?:\s+|^)(ext\.?|extension|poste|x)\s*(\d{{1,6}})\s*$', 2) AS number,
         trim(regexp_replace(raw, '(?i)(?:\s+|^)(ext\.?|extension|poste|x)\s*(\d{{1,6}})\s*$', '')) AS before FROM p0),
p2 AS (SELECT *, marker <> '' AND NOT (lower(marker) = 'x' AND len(regexp_replace(before, '[^0-9]', '', 'g')) < 6) AS takes FROM p1),
p3 AS (SELECT *, CASE WHEN takes THEN before ELSE raw END AS t FROM p2),
p4 AS (SELECT *, CASE WHEN starts_with(t, '+') THEN 'plus' WHEN starts_with(t, '00') AND NOT starts_with(t, '0000') AND len(t) - 2 >= 6 THEN 'double_zero' ELSE 'none' END AS prefix FROM p3),
p5 AS (SELECT *, regexp_replace(CASE prefix WHEN 'plus' THEN t[2:] WHEN 'double_zero' THEN t[3:] ELSE t END, '[^0-9]', '', 'g') AS digits FROM p4),
p6 AS (SELECT *, CASE WHEN prefix = 'none' THEN '' WHEN len(digits) > 3 AND digits[:3] IN ({_CODES}) THEN digits[:3] WHEN len(digits) > 2 AND digits[:2] IN ({_CODES}) THEN digits[:2]
         WHEN len(digits) > 1 AND digits[:1] IN ({_CODES}) THEN digits[:1] ELSE '' END AS code FROM p5),
ph AS (SELECT c_custkey, c_nationkey, digits, prefix, code, CASE WHEN code <> '' THEN digits[len(code) + 1:] ELSE '' END AS nat, CASE WHEN takes THEN number ELSE '' END AS ext,
         len(digits) >= 6 AND NOT regexp_matches(t, '[A-Za-z]') AS valid FROM p6)"""


@query(f"WITH {PHONE_SQL} SELECT c_custkey, digits, prefix, code AS country_code, nat AS national_number, ext AS extension, valid AS is_valid, prefix <> 'none' AND len(nat) >= 7 AS is_complete FROM ph")
def phone_parse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select("c_custkey", phone.parse(F.expr(SPARK_PHONE_TEXT)).alias("p"))
    return p.select("c_custkey", "p.digits", "p.prefix", "p.country_code", "p.national_number", "p.extension", "p.is_valid", "p.is_complete")


@query(
    f"""WITH {PHONE_SQL}, m AS (SELECT x.c_custkey AS a, y.c_custkey AS b, x.digits AS xd, y.digits AS yd, x.prefix AS xp, y.prefix AS yp, x.code AS xc, y.code AS yc, x.nat AS xn, y.nat AS yn, x.valid AS xv, y.valid AS yv
  FROM ph x JOIN ph y ON x.c_nationkey = y.c_nationkey AND x.c_custkey < y.c_custkey),
z AS (SELECT *, CASE WHEN xp <> 'none' THEN xn ELSE yn END AS nat, CASE WHEN xp <> 'none' THEN yd ELSE xd END AS loc, CASE WHEN xp <> 'none' THEN xc ELSE yc END AS code FROM m)
SELECT a, b, CASE WHEN NOT xv OR NOT yv OR xd = '' OR yd = '' THEN 'insufficient'
  WHEN xp <> 'none' AND yp <> 'none' THEN CASE WHEN xd = yd THEN CASE WHEN xp <> yp THEN 'intl_prefix_equivalent' ELSE 'exact_match' END WHEN len(xd) >= 7 AND len(yd) >= 7 THEN 'conflict' ELSE 'insufficient' END
  WHEN (xp <> 'none') <> (yp <> 'none') THEN CASE WHEN code <> '' AND nat <> '' THEN CASE WHEN nat = loc AND len(nat) >= 7 THEN 'compatible_local_intl' WHEN len(nat) >= 7 AND len(loc) >= 7 AND nat[-7:] = loc[-7:] THEN 'weak_suffix_overlap' ELSE 'insufficient' END
       WHEN len(xd) >= 7 AND len(yd) >= 7 AND xd[-7:] = yd[-7:] THEN 'weak_suffix_overlap' ELSE 'insufficient' END
  WHEN xd = yd THEN 'exact_match' WHEN len(xd) >= 7 AND len(yd) >= 7 THEN 'conflict' ELSE 'insufficient' END AS outcome FROM z"""
)
def phone_compare(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one nation's customers."""
    p = table(spark, d, "customer").select("c_custkey", "c_nationkey", phone.parse(F.expr(SPARK_PHONE_TEXT)).alias("p")).withColumn("r", phone.read(F.col("p"))).select("c_custkey", "c_nationkey", "r.*")
    met = pairs_within(p, "c_nationkey", "c_custkey", p.columns[2:])
    return met.select(F.col("x.c_custkey").alias("a"), F.col("y.c_custkey").alias("b"), phone.outcome_read(F.col("x"), F.col("y")).alias("outcome"))


@query(f"WITH {PHONE_SQL}, k AS (SELECT c_nationkey AS scope, c_custkey AS record, digits[-7:] AS key FROM ph WHERE len(digits) >= 7) SELECT x.scope, x.record AS a, y.record AS b FROM k x JOIN k y ON x.scope = y.scope AND x.key = y.key AND x.record < y.record")
def phone_suffix_block(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("p", phone.parse(F.expr(SPARK_PHONE_TEXT)))
    keys = {"phone_suffix": F.when(F.length("p.digits") >= 7, F.substring(F.col("p.digits"), -7, 7))}
    return blocking.emissions(blocking.key_table(c, keys, "c_nationkey", "c_custkey")).select("scope", "a", "b")


# ---- comparators one by one


def _field(name: str, short: str):
    sql = f"WITH {COMPARED_SQL.replace('{review}', '0.15').replace('{link}', '0.35')} SELECT scope, a, b, {short}c AS class, {dict(a='ag').get(short, short)}s AS score FROM d"

    def run(spark: SparkSession, d: str) -> DataFrame:
        cell = F.filter("comparisons", lambda c: c["field"] == name)[0]
        return compared_orders(spark, d).select("scope", "a", "b", cell["class"].alias("class"), cell["score"].alias("score"))

    return run, sql


for _name, _short, _key in (("date_of_birth", "d", "date_compare"), ("age", "a", "age_compare"), ("government_id", "g", "exact_id_compare"), ("language", "l", "overlap_compare"), ("last_known_location", "o", "location_compare")):
    QUERIES[_key], SQL[_key] = _field(_name, _short)


_CLOCK = "(event_id % 12 + 1) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || CASE event_id % 3 WHEN 0 THEN ' p.m.' WHEN 1 THEN ' am' ELSE '' END"
_MINUTES = "CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 12 + 1 < 12 THEN event_id % 12 + 13 ELSE 12 END WHEN event_id % 3 = 1 AND event_id % 12 + 1 = 12 THEN 0 ELSE event_id % 12 + 1 END * 60 + event_id % 60"


@query(
    f"""WITH e AS (SELECT event_id, user_id, {_MINUTES} AS m FROM events)
SELECT x.event_id AS a, y.event_id AS b, CASE WHEN y.m >= x.m OR abs(y.m - x.m) <= 30 THEN 'compatible' ELSE 'conflict' END AS class
FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id"""
)
def time_window_compare(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one user's events."""
    e = table(spark, d, "events").select("event_id", "user_id", F.concat(F.lit("seen around "), F.expr(_CLOCK.replace("VARCHAR", "STRING"))).alias("said"))
    side = lambda s: e.select("user_id", F.col("event_id").alias(s), F.col("said").alias(f"t{s}"))
    met = side("a").join(side("b"), "user_id").where("a < b")
    return met.select("a", "b", compare.time_window(F.col("ta"), F.col("tb"), POLICY["last_seen_time"])["class"].alias("class"))


@query(
    """WITH p AS (SELECT p_partkey, p_brand, p_size, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS t FROM part)
SELECT x.p_partkey AS a, y.p_partkey AS b, len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) AS jaccard
FROM p x JOIN p y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey"""
)
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of one brand's and size's parts; names that are equal are compared once for a brand and size, then spelt out into their parts."""
    p = table(spark, d, "part").where("p_partkey is not null").select("p_brand", "p_size", "p_partkey", "p_name", F.coalesce(F.concat(F.lit("="), "p_name"), F.lit("")).alias("n"))
    named = p.groupBy("p_brand", "p_size", "n").agg(F.collect_list("p_partkey").alias("keys"), text.tokens(F.max("p_name")).alias("t"))
    side = lambda s: named.select("p_brand", "p_size", *[F.col(c).alias(f"{c}_{s}") for c in ("n", "keys", "t")])
    met = side("x").join(side("y"), ["p_brand", "p_size"]).where("n_x <= n_y").select(text.token_jaccard(F.col("t_x"), F.col("t_y")).alias("jaccard"), (F.col("n_x") == F.col("n_y")).alias("one"), "keys_x", "keys_y", "p_brand", "p_size", "n_x", "n_y")
    each = dealt(met, "p_brand", "p_size", "n_x", "n_y").select("jaccard", "one", "keys_y", F.explode("keys_x").alias("i")).select("jaccard", "one", "i", F.explode("keys_y").alias("j"))
    return each.where("i < j or (i > j and not one)").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "jaccard")


@query()
def indel_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Name similarity of all pairs of different part names, by the native fold (tests hold it against the Arrow version and brute force)."""
    p = table(spark, d, "part").select("p_name").distinct()
    a, b = p.select(F.col("p_name").alias("a")), p.select(F.col("p_name").alias("b"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", text.indel_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query()
def name_channels(spark: SparkSession, d: str) -> DataFrame:
    """Channel, class and share of all pairs of different part names. A name's first character says nothing across scripts, and no key of a channel is exact for ratios, so none keeps pairs apart."""
    p = table(spark, d, "part").select("p_name").distinct().select("p_name", names.represent("p_name").alias("r"))
    a, b = p.select(F.col("p_name").alias("a"), F.col("r").alias("ra")), p.select(F.col("p_name").alias("b"), F.col("r").alias("rb"))
    met = a.join(b, F.col("a") < F.col("b"))
    for c in ("unicode", "latin", "skeleton"):
        met = met.withColumn(f"{c}_ratio", names.indel_ratio(F.col(f"ra.{c}"), F.col(f"rb.{c}")))
    chan = names.channel(F.col("ra"), F.col("rb"), F.col("unicode_ratio"), F.col("latin_ratio"), F.col("skeleton_ratio"))
    met = met.withColumn("channel", chan)
    out = compare.name(F.col("a"), F.col("b"), POLICY["full_name"], F.col("channel"), F.col("ra.is_short"))
    return met.select("a", "b", "channel", out["class"].alias("class"), out["score"].alias("score"))


# ---- decisions


@query(f"WITH {DECIDED_SQL} SELECT scope, a, b, state, reasons, score FROM dd")
def linkage_decision(spark: SparkSession, d: str) -> DataFrame:
    return decided_orders(spark, d)


@query(f"WITH {DECIDED_SQL} SELECT scope, a, b, raw AS total FROM d")
def linkage_score(spark: SparkSession, d: str) -> DataFrame:
    return compared_orders(spark, d).select("scope", "a", "b", compare.total_score(F.col("comparisons")).alias("total"))


@query(f"WITH {DECIDED_SQL} SELECT state, count(*) AS n, sum(CAST(round(score * 10000) AS BIGINT))::BIGINT AS points FROM dd GROUP BY state")
def decision_by_state(spark: SparkSession, d: str) -> DataFrame:
    return decided_orders(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("score") * 10000).cast("long")).alias("points"))


SWEEP = ((0.20, 0.10), (0.25, 0.12), (0.30, 0.15), (0.35, 0.15), (0.40, 0.18), (0.45, 0.20), (0.50, 0.25))


@query(
    f"""WITH v(link, review) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in SWEEP)}), {COMPARED_SQL[: COMPARED_SQL.index("d AS (SELECT *, round")].rstrip().rstrip(",")},
d AS (SELECT link, review, CASE WHEN blocked THEN 'blocked_by_conflict' WHEN gc = 'exact_match' THEN 'link_recommended' WHEN len(w) > 0 OR raw < review THEN 'insufficient_evidence'
  WHEN raw >= link AND len(cats) >= 2 THEN 'link_recommended' ELSE 'human_review_required' END AS state FROM u, v)
SELECT link, review, state, count(*) AS n FROM d GROUP BY ALL"""
)
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """States under seven pairs of thresholds, in one pass over the compared pairs (the seven are a literal, so rows grow seven times, not by a join)."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("link"), F.lit(b).alias("review")) for a, b in SWEEP]))
    swept = compared_orders(spark, d).select("comparisons", grid.alias("t"))
    state = decide.decision(F.col("comparisons"), F.col("t.link"), F.col("t.review"))["state"]
    return swept.select(F.col("t.link").alias("link"), F.col("t.review").alias("review"), state.alias("state")).groupBy("link", "review", "state").agg(F.count(F.lit(1)).alias("n"))


_RANKED_SQL = DECIDED_SQL + ", rk AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a, b) AS rank FROM dd)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return decided_orders(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("scope").orderBy("a", "b")))


@query(
    f"""WITH {_RANKED_SQL}, g AS (SELECT *, coalesce(abs(nth_value(score, 1) OVER w - nth_value(score, 2) OVER w) <= 0.2, false) AS close FROM rk WINDOW w AS (PARTITION BY scope ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT scope, a, b, rank, state, close, CASE WHEN close AND state = 'link_recommended' THEN 'human_review_required' ELSE state END AS final_state FROM g"""
)
def rival_downgrade(spark: SparkSession, d: str) -> DataFrame:
    return decide.rival_downgrade(_ranked(spark, d)).select("scope", "a", "b", "rank", "state", "close", "final_state")


@query(
    f"""WITH {DECIDED_SQL}, x AS (SELECT scope, a, b, score, unnest([a, b]) AS shared FROM dd)
SELECT x.scope, x.a, x.b, array_to_string(list_sort(list(DISTINCT CASE WHEN y.a = x.shared THEN y.b ELSE y.a END)), ',') AS rivals
FROM x JOIN x y ON x.scope = y.scope AND x.shared = y.shared AND (x.a <> y.a OR x.b <> y.b) AND abs(x.score - y.score) <= 0.15 GROUP BY x.scope, x.a, x.b"""
)
def close_rivals(spark: SparkSession, d: str) -> DataFrame:
    return decide.close_rivals(decided_orders(spark, d)).select("scope", "a", "b", F.array_join("rivals", ",").alias("rivals"))


_MAP = lambda col, m: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.items()) + " END"


@query(f"WITH {DECIDED_SQL} SELECT {_MAP('state', policy.CLASSIFICATION)} AS classification, {_MAP('state', policy.PRIORITY)} AS priority, {_MAP('state', {k: ','.join(v) for k, v in policy.ACTIONS.items()})} AS actions, count(*) AS n FROM dd GROUP BY ALL")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("state")
    return decided_orders(spark, d).groupBy(decide.classification(s).alias("classification"), decide.priority(s).alias("priority"), decide.actions(s).alias("actions")).agg(F.count(F.lit(1)).alias("n"))


_PROPOSED = "list_extract([" + ", ".join(f"'{s}'" for s in policy.STATES) + "], CAST((a + b) % 6 + 1 AS INTEGER))"
_ALLOWED = " OR ".join(f"(state = '{k}' AND q IN ({', '.join(repr(x) for x in v)}))" for k, v in policy.TRANSITIONS.items())


@query(f"WITH {DECIDED_SQL}, z AS (SELECT scope, a, b, state, {_PROPOSED} AS q FROM dd) SELECT scope, a, b, q AS proposed, CASE WHEN {_ALLOWED} THEN q ELSE state END AS final_state FROM z")
def adjudication_floor(spark: SparkSession, d: str) -> DataFrame:
    proposed = F.element_at(F.array(*[F.lit(s) for s in policy.STATES]), ((F.col("a") + F.col("b")) % 6 + 1).cast("int"))
    z = decided_orders(spark, d).withColumn("proposed", proposed)
    return z.select("scope", "a", "b", "proposed", decide.adjudicated(F.col("state"), F.col("proposed")).alias("final_state"))


@query(
    """WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS f FROM lineitem GROUP BY ALL)
SELECT l_orderkey, first(l_returnflag ORDER BY n DESC, f, l_returnflag) AS winner, count(*) = 1 AS unanimous FROM v GROUP BY l_orderkey"""
)
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    return decide.majority(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_linenumber")


@query(
    f"""WITH {DECIDED_SQL} SELECT scope, a, b, state || ': ' || replace(reasons, ',', ', ') || ' (score ' || printf('%.4f', score) || ')' AS explanation FROM dd"""
)
def decision_explanation(spark: SparkSession, d: str) -> DataFrame:
    x = compared_orders(spark, d).select("scope", "a", "b", decide.decision(F.col("comparisons")).alias("d"))
    return x.select("scope", "a", "b", decide.explanation(F.col("d")).alias("explanation"))
