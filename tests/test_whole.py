"""Queries over whole scopes: no pair or event may be left out for the number of its id."""

import hashlib
from collections import defaultdict

from corrolink.functions import names
from corrolink.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
OVER_ORDERS = "linkage_decision linkage_score rival_downgrade adjudication_floor decision_explanation date_compare age_compare exact_id_compare overlap_compare location_compare".split()


def test_all_orders_of_a_customer_meet(spark, sf_dir, duck):
    import __spark_entry__

    (n,) = duck.execute("select cast(sum(n * (n - 1) / 2) as bigint) from (select count(*) n from orders group by o_custkey)").fetchone()
    assert __spark_entry__.entry(spark).count() == n
    assert {q: QUERIES[q](spark, sf_dir).count() for q in OVER_ORDERS} == dict.fromkeys(OVER_ORDERS, n)
    for q in ("decision_by_state", "review_queue"):
        assert QUERIES[q](spark, sf_dir).groupBy().sum("n").first()[0] == n
    assert QUERIES["threshold_sweep"](spark, sf_dir).groupBy().sum("n").first()[0] == 7 * n


def test_orders_of_one_government_id_meet_over_any_distance(spark, sf_dir, duck):
    far = duck.execute("select count(*) from orders x join orders y on x.o_custkey = y.o_custkey and x.o_orderkey < y.o_orderkey and x.o_orderkey // 400 < y.o_orderkey // 400 where x.o_orderkey % 11 = 0 and y.o_orderkey % 11 = 0").fetchone()[0]
    got = QUERIES["exact_id_compare"](spark, sf_dir).where("a % 11 = 0 and b % 11 = 0 and floor(a / 400) < floor(b / 400) and class = 'exact_match'").count()
    assert got == far > 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chain_of_all_events(spark, sf_dir, duck):
    runs = defaultdict(list)
    for run, kind in duck.execute("select user_id, event_type from events order by user_id, ts, event_id").fetchall():
        runs[run].append(kind)
    built, checked = set(), {}
    for run, kinds in runs.items():
        last, chain = "0" * 64, []
        for n, kind in enumerate(kinds, 1):
            h = sha(f"{run}|{n}|{sha(kind)}|{last}")
            chain.append((run, n, kind, last, h))
            last = h
        built.update(chain)
        if run % 4 == 1 and len(chain) > 3:
            checked[run] = ("incomplete", 3, 2, "3", "")
        elif run % 3 == 0 and len(chain) >= 4:
            checked[run] = ("broken", 4, 3, "", "")
        else:
            checked[run] = ("verified", 0, min(len(chain), 2) if run % 4 == 1 else len(chain), "", "")
    got = QUERIES["audit_chain_build"](spark, sf_dir).select("run", "sequence", "payload", "previous_hash", "event_hash").collect()
    assert len(got) == len(built) == duck.execute("select count(*) from events").fetchone()[0] and {tuple(r) for r in got} == built
    assert {r["run"]: (r["status"], r["first_invalid"], r["verified_events"], r["missing"], r["doubled"]) for r in QUERIES["audit_chain_verify"](spark, sf_dir).collect()} == checked


def test_no_block_of_ids_keeps_pairs_apart(spark, tmp_path):
    spark.range(1, 2).selectExpr("7L as c_nationkey", "explode(array(9L, 9L + 90000)) as c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(1, 2).selectExpr("3L as user_id", "explode(array(0L, 720001L)) as event_id").write.parquet(str(tmp_path / "events.parquet"))
    spark.range(1, 2).selectExpr("'B' as p_brand", "5 as p_size", "'T' as p_type", "'hot ring' as p_name", "explode(array(1L, 90001L)) as p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    rows = lambda q: [tuple(r) for r in QUERIES[q](spark, str(tmp_path)).collect()]
    assert rows("phone_compare") == [(9, 90009, "exact_match")]
    assert rows("time_window_compare") == [(0, 720001, "conflict")]
    assert [r[:2] for r in rows("retrieval_score")] == [r[:2] for r in rows("pair_evidence_audit")] == [(1, 90001)]


def test_names_meet_whatever_their_first_letters(spark, tmp_path):
    said = ["Yusuf Ali", "Юсуф Али", "hot ring", "not ring", "Ivan Petrov", "Иван Петров"]
    spark.createDataFrame([(k, n) for k, n in enumerate(said + said[:2])], "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    ratio = {(r["a"], r["b"]): r["ratio"] for r in QUERIES["indel_ratio"](spark, str(tmp_path)).collect()}
    pairs = {(a, b) for a in said for b in said if a < b}
    assert ratio.keys() == pairs and all(abs(v - names.ratio(*p)) < 1e-9 for p, v in ratio.items())
    channel = {(r["a"], r["b"]): (r["channel"], r["score"]) for r in QUERIES["name_channels"](spark, str(tmp_path)).collect()}
    assert channel.keys() == pairs
    assert channel["Ivan Petrov", "Иван Петров"][1] > 0 and channel["hot ring", "not ring"][1] > 0
