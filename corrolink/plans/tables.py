"""Reading the driver's tables, and the records that queries derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import policy, text
from ..operators import blocking, compare, decide


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """Rows dealt out by the columns over several tasks a core: few small rows that make many pairs are not left to one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *cols)


def pairs_within(records: DataFrame, scope: str, key: str, fields: list[str], block: int = 2000) -> DataFrame:
    """(x, y): structs of key and fields, all pairs of one scope's records with x's key below y's.

    A scope's records are cut into blocks in the order of their keys and blocks are paired, so that no pair is formed
    twice to be dropped and tasks are alike however few scopes there are. Of two blocks that meet, x's records come one
    at a time to y's list: a task holds the pairs of one record and one block, not those of two blocks. It also holds the
    lists of its own block pairs, so there are as many tasks as keep those at about a hundred.
    """
    records = records.where(F.col(scope).isNotNull() & F.col(key).isNotNull())
    n = F.ceil(F.count(F.lit(1)) / block)
    met = records.groupBy(scope).agg((n * (n + 1) / 2).alias("n")).agg(F.sum("n")).first()[0] or 0
    tasks = max(4 * records.sparkSession.sparkContext.defaultParallelism, int(met) // 100)
    by = Window.partitionBy(scope)
    at = lambda place: F.floor((place - 1) / block).cast("int")
    cut = records.select(scope, F.struct(key, *fields).alias("x"), at(F.row_number().over(by.orderBy(key))).alias("_x"), at(F.count(F.lit(1)).over(by)).alias("_last"))
    blocks = cut.groupBy(scope, F.col("_x").alias("_y")).agg(F.collect_list("x").alias("rows"))
    cell = [scope, "_x", "_y"]
    xs = cut.select(scope, "_x", F.explode(F.sequence("_x", "_last")).alias("_y"), "x").repartition(tasks, *cell)
    ys = blocks.select(scope, F.explode(F.sequence(F.lit(0), "_y")).alias("_x"), "_y", "rows").repartition(tasks, *cell)
    return xs.join(ys.hint("shuffle_hash"), cell).select("x", F.explode("rows").alias("y")).where(F.col(f"x.{key}") < F.col(f"y.{key}"))


# ---- candidate pairs over customers: scope is the nation


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    keys = {
        "government_id": F.when(key % 5 == 0, F.concat(F.lit("G"), key % 350)),
        "name_plus_location": F.concat(F.col("c_mktsegment"), F.lit("|"), F.floor(F.col("c_acctbal") / 40)),
        "phone_suffix": (key * 37 % 900).cast("string"),
    }
    return blocking.key_table(c, keys, "c_nationkey", "c_custkey")


EMITTED_SQL = """
r AS (SELECT c_nationkey AS scope, c_custkey AS record, CASE WHEN c_custkey % 5 = 0 THEN 'G' || (c_custkey % 350) END AS g,
        c_mktsegment || '|' || CAST(floor(c_acctbal / 40) AS BIGINT) AS n, CAST(c_custkey * 37 % 900 AS VARCHAR) AS s FROM customer),
k AS (SELECT scope, record, 'government_id' AS rule, g AS key FROM r WHERE g IS NOT NULL
      UNION ALL SELECT scope, record, 'name_plus_location', n FROM r WHERE n IS NOT NULL
      UNION ALL SELECT scope, record, 'phone_suffix', s FROM r),
e AS (SELECT x.scope, x.record AS a, y.record AS b, x.rule FROM k x JOIN k y ON x.scope = y.scope AND x.rule = y.rule AND x.key = y.key AND x.record < y.record),
p AS (SELECT scope, a, b, list_sort(list(DISTINCT rule)) AS rules FROM e GROUP BY scope, a, b)"""


# ---- compared pairs over orders: scope is the customer, a record is an order

POLICY = {p.name: p for p in policy.POLICIES}


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("scope"),
        key.alias("record"),
        F.when(key % 3 == 0, day).when(key % 3 == 1, F.substring(day, 1, 7)).otherwise(F.substring(day, 1, 4)).alias("date_of_birth"),
        F.floor(F.col("o_totalprice") / 5000).cast("string").alias("age"),
        F.when(key % 11 == 0, F.concat(F.lit("GOV-"), F.col("o_custkey"))).when(key % 11 == 1, F.concat(F.lit("GOV-"), key)).alias("government_id"),
        F.col("o_orderstatus").alias("language"),
        F.when(key % 4 > 0, F.col("o_orderpriority")).alias("last_known_location"),
    )


def compared_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, a, b, comparisons): all pairs of one customer's orders, compared field by field in policy order."""
    fields = ["date_of_birth", "age", "government_id", "language", "last_known_location"]
    # what the comparators read is found once for each record, below the join
    reads = {
        "dob_parts": text.date_parts(F.col("date_of_birth")),
        "years": text.age(F.col("age")),
        "id_plain": compare.plain(F.col("government_id")),
        "words": text.tokens(F.col("language")),
        "place_plain": compare.plain(F.col("last_known_location")),
        "place_words": text.tokens(F.col("last_known_location")),
    }
    # dealt out by scope before the self-join: pairs outnumber records, so their tasks must not be those of a small scan
    r = order_records(spark, sf_dir).withColumns(reads).repartition("scope")
    side = lambda s: r.select("scope", F.col("record").alias(s), *[F.col(f).alias(f"{s}_{f}") for f in (*fields, *reads)])
    met = side("a").join(side("b"), "scope").where("a < b")
    ab = lambda f: (F.col(f"a_{f}"), F.col(f"b_{f}"))
    outcomes = {
        "date_of_birth": compare.date(*ab("date_of_birth"), POLICY["date_of_birth"], read=ab("dob_parts")),
        "age": compare.age(*ab("age"), POLICY["age"], read=ab("years")),
        "government_id": compare.exact(*ab("government_id"), POLICY["government_id"], read=ab("id_plain")),
        "language": compare.overlap(*ab("language"), POLICY["language"], read=ab("words")),
        "last_known_location": compare.place(*ab("last_known_location"), POLICY["last_known_location"], read=ab("place_plain"), tokens=ab("place_words")),
    }
    # outcomes are columns of their own first: named several times below, each is found once
    met = met.withColumns({f"o_{f}": o for f, o in outcomes.items()})
    cells = F.array(*[compare.compared(f, POLICY[f].reliability, F.col(f"o_{f}")) for f in fields])
    return met.select("scope", "a", "b", *[F.col(f"{s}_{f}") for s in "ab" for f in fields], cells.alias("comparisons"))


def decided_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = compared_orders(spark, sf_dir).select("scope", "a", "b", decide.decision(F.col("comparisons")).alias("d"))
    return d.select("scope", "a", "b", F.col("d.state").alias("state"), F.array_join("d.reasons", ",").alias("reasons"), F.col("d.score").alias("score"))


#: One row for a pair with class, score and block of every field.
COMPARED_SQL = r"""
o AS (SELECT o_custkey AS scope, o_orderkey AS record,
        CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y') END AS dob,
        CAST(floor(o_totalprice / 5000) AS BIGINT) AS age,
        CASE WHEN o_orderkey % 11 = 0 THEN 'GOV-' || o_custkey WHEN o_orderkey % 11 = 1 THEN 'GOV-' || o_orderkey END AS gov,
        lower(o_orderstatus) AS lang, CASE WHEN o_orderkey % 4 > 0 THEN lower(o_orderpriority) END AS loc FROM orders),
m AS (SELECT x.scope, x.record AS a, y.record AS b, x.dob AS xd, y.dob AS yd, x.age AS xa, y.age AS ya, x.gov AS xg, y.gov AS yg, x.lang AS xl, y.lang AS yl, x.loc AS xo, y.loc AS yo
      FROM o x JOIN o y ON x.scope = y.scope AND x.record < y.record),
c AS (SELECT scope, a, b,
        CASE WHEN xd[:4] <> yd[:4] OR (len(xd) >= 7 AND len(yd) >= 7 AND xd[:7] <> yd[:7]) OR (len(xd) = 10 AND len(yd) = 10 AND xd <> yd) THEN 'strong_conflict'
             WHEN len(xd) = 10 AND len(yd) = 10 THEN 'exact_match' WHEN len(xd) >= 7 AND len(yd) >= 7 THEN 'normalized_match' ELSE 'compatible' END AS dc,
        CASE WHEN xa > 999 OR ya > 999 THEN 'insufficient' WHEN abs(xa - ya) = 0 THEN 'exact_match' WHEN abs(xa - ya) <= 1 THEN 'normalized_match' WHEN abs(xa - ya) <= 3 THEN 'compatible'
             WHEN abs(xa - ya) < 5 THEN 'conflict' ELSE 'strong_conflict' END AS ac,
        CASE WHEN xg IS NULL AND yg IS NULL THEN 'missing_both' WHEN xg IS NULL THEN 'missing_left' WHEN yg IS NULL THEN 'missing_right' WHEN lower(xg) = lower(yg) THEN 'exact_match' ELSE 'conflict' END AS gc,
        CASE WHEN xl = yl THEN 'compatible' ELSE 'conflict' END AS lc,
        CASE WHEN xo IS NULL AND yo IS NULL THEN 'missing_both' WHEN xo IS NULL THEN 'missing_left' WHEN yo IS NULL THEN 'missing_right' WHEN xo = yo THEN 'exact_match'
             WHEN len(list_intersect(regexp_extract_all(xo, '[a-z0-9]+'), regexp_extract_all(yo, '[a-z0-9]+'))) > 0 THEN 'partial_match' ELSE 'conflict' END AS oc FROM m),
s AS (SELECT *, CASE dc WHEN 'exact_match' THEN 0.18::DOUBLE WHEN 'normalized_match' THEN 0.144::DOUBLE WHEN 'compatible' THEN 0.054::DOUBLE ELSE 0::DOUBLE END AS ds,
        CASE ac WHEN 'exact_match' THEN 0.08::DOUBLE WHEN 'normalized_match' THEN 0.064::DOUBLE WHEN 'compatible' THEN 0.032::DOUBLE ELSE 0::DOUBLE END AS ags,
        CASE gc WHEN 'exact_match' THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS gs, CASE lc WHEN 'compatible' THEN 0.03::DOUBLE ELSE 0::DOUBLE END AS ls,
        CASE oc WHEN 'exact_match' THEN 0.03::DOUBLE WHEN 'partial_match' THEN 0.009::DOUBLE ELSE 0::DOUBLE END AS os FROM c),
t AS (SELECT *, ((((0::DOUBLE + ds) + ags) + gs) + ls) + os AS raw,
        (dc = 'strong_conflict' OR ac = 'strong_conflict' OR gc = 'conflict') AS blocked,
        dc IN ('exact_match', 'normalized_match') OR ac IN ('exact_match', 'normalized_match') OR gc = 'exact_match' OR oc = 'exact_match' AS supported,
        list_distinct(list_filter([CASE WHEN ds > 0 THEN 'strong' END, CASE WHEN ags > 0 THEN 'weak' END, CASE WHEN gs > 0 THEN 'unique' END, CASE WHEN ls > 0 THEN 'weak' END, CASE WHEN os > 0 THEN 'context' END], lambda z: z IS NOT NULL)) AS cats FROM s),
u AS (SELECT *, list_filter([CASE WHEN len(cats) > 0 AND len(list_filter(cats, lambda z: z NOT IN ('weak', 'context'))) = 0 THEN 'insufficient_distinctive_fields' END,
        CASE WHEN oc = 'exact_match' AND len(cats) = 1 AND cats[1] = 'context' THEN 'location_only' END], lambda z: z IS NOT NULL) AS w FROM t),
d AS (SELECT *, round(raw, 4) AS score,
        CASE WHEN blocked THEN 'blocked_by_conflict' WHEN gc = 'exact_match' THEN 'link_recommended' WHEN len(w) > 0 OR raw < {review} THEN 'insufficient_evidence'
             WHEN raw >= {link} AND len(cats) >= 2 THEN 'link_recommended' ELSE 'human_review_required' END AS state FROM u)"""
DECIDED_SQL = (
    COMPARED_SQL.replace("{review}", "0.15").replace("{link}", "0.35")
    + """,
dd AS (SELECT scope, a, b, state, score,
        CASE state WHEN 'blocked_by_conflict' THEN array_to_string(list_filter([CASE WHEN gc = 'conflict' THEN 'government_id_conflict' END, CASE WHEN dc = 'strong_conflict' THEN 'date_of_birth_conflict' END,
             CASE WHEN ac = 'strong_conflict' THEN 'age_hard_conflict' END], lambda z: z IS NOT NULL), ',')
        WHEN 'link_recommended' THEN CASE WHEN gc = 'exact_match' THEN 'unique_identifier_match' ELSE 'multi_field_agreement' END
        WHEN 'insufficient_evidence' THEN CASE WHEN len(w) > 0 THEN array_to_string(w, ',') ELSE 'no_supporting_evidence' END
        ELSE CASE WHEN gc LIKE 'missing%' THEN 'missing_key_discriminator' ELSE 'ambiguous_evidence' END END AS reasons FROM d)"""
)
