"""Rows on which queries once differed from their SQL, and shortcuts that once stood in for a method's steps."""

from corrolink.plans import registry

from .helpers import assert_same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def over(spark, path, **tables):
    """DuckDB over the tables, which are written to the path for Spark."""
    import duckdb

    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(path / f"{name}.parquet"))
        con.execute(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    return con


def test_redaction_takes_words_as_its_sql_does(spark, tmp_path):
    said = ["ébob@mail.example.com", "电话bob@mail.example.comé", "9\u000b7 Old King Roadé", "9 ſt Ave", "diagnoſis: flu.", "еdiagnosis:\u000b.", "a\U0001d4000123456789", "+44 20 7946 0123+0123456789", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "doc_id long, text string")
    con = over(spark, tmp_path, documents=docs)
    assert_same(QUERIES["pii_redaction"](spark, str(tmp_path)), con, SQL["pii_redaction"])


def test_chat_renders_every_prefix_by_its_own_template(monkeypatch):
    from corrolink.llm import chat

    seen, own = [], chat.chatml

    def spy(turns):
        seen.append(len(turns))
        return own(turns)

    vars(spy).update(vars(own))
    monkeypatch.setattr(chat, "chatml", spy)
    row = chat._digest(1, [("user", "a"), ("assistant", "b"), ("user", "c")])
    assert set(seen) == {0, 1, 2, 3} and row["n_turns"] == 3 and row["loss_chars"] == 1 and row["rewritten_at"] is None


def parts(spark, n=60):
    """Parts of one brand, with names and keys that come twice, types of more words than have bits of their own."""
    rows = [(k // 2 if k % 9 == 0 else k, f"{('blue', 'navy', 'red')[k % 3]} {('hot', 'ring')[k % 2]}", f"WORD{chr(97 + k % 26)}{chr(97 + k * 7 % 26)} {('TIN', 'STEEL')[k % 2] if k % 5 else 'X' + chr(97 + k % 20)}", k % 7 + 1) for k in range(n)]
    return spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").selectExpr("*", "'B' as p_brand")


def dealt_out(spark, df):
    return df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pairs_of_parts_are_dealt_out_and_equal_their_sql(spark, tmp_path):
    con = over(spark, tmp_path, part=parts(spark))
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # as where rows are few and small
    try:
        for q in ("token_jaccard", "retrieval_score", "pair_evidence_audit"):
            df = QUERIES[q](spark, str(tmp_path))
            assert_same(df, con, SQL[q])
            assert dealt_out(spark, df), q
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pairs_of_customers_are_dealt_out_and_equal_their_sql(spark, tmp_path):
    con = over(spark, tmp_path, customer=spark.range(300).selectExpr("id * 1117 as c_custkey", "cast(id % 2 as int) as c_nationkey"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = QUERIES["phone_compare"](spark, str(tmp_path))
        assert_same(df, con, SQL["phone_compare"])
        assert dealt_out(spark, df)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fuzzy_baseline_compares_two_texts_once(spark, tmp_path, monkeypatch):
    from corrolink.functions import names
    from corrolink.operators import synth
    from pyspark.sql import functions as F

    over(spark, tmp_path, part=parts(spark))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(a, b):
        calls.add(1)
        return names.ratio(a, b)

    monkeypatch.setattr(synth.names, "indel_ratio", counted)
    got = {r["scope"]: (r["a"], r["b"], r["ratio"]) for r in QUERIES["fuzzy_baseline"](spark, str(tmp_path)).collect()}
    of = {}
    for r in parts(spark).collect():
        of.setdefault(f"B|{r['p_size']}", []).append((r["p_partkey"], r["p_name"]))
    best = {s: min(((-names.ratio(x, y), a, b) for a, x in rs for b, y in rs if a < b)) for s, rs in of.items()}
    assert got == {s: (a, b, -r) for s, (r, a, b) in best.items()} and calls.value <= 21  # six names: 21 pairs, equal ones too


def test_close_rivals_are_found_without_a_join_of_candidates(spark):
    from corrolink.operators import decide

    rows = [(1, 1, 2, 0.5), (1, 1, 2, 0.9), (1, 1, 3, 0.6), (1, 2, 3, 0.1), (1, 3, 4, 0.2), (2, 1, 2, 0.5), (None, 1, 2, 0.5), (None, 1, 3, 0.5), (3, 1, 2, None), (3, 1, 3, None)]
    df = decide.close_rivals(spark.createDataFrame(rows, "scope long, a long, b long, score double"))
    want = {}
    for s, a, b, x in rows:
        for t, c, d, y in rows:
            for shared in {a, b} & {c, d}:
                if s is not None and s == t and (a, b) != (c, d) and None not in (x, y) and abs(x - y) <= 0.15:
                    want.setdefault((s, a, b), set()).add(d if c == shared else c)
    assert {tuple(r)[:3]: r["rivals"] for r in df.collect()} == {k: sorted(v) for k, v in want.items()}
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()


def loops_of_a_task(df):
    """Nested loops that one row of the last shuffle goes through; Spark holds all rows that they make of it."""
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.split("Exchange|Join", plan)[0].count("Generate")


def test_a_task_holds_pairs_of_one_record_and_one_block(spark, tmp_path):
    from corrolink.plans.tables import pairs_within

    rows = [(k // 2 if k % 9 == 0 else k, k % 3 if k % 7 else None) for k in range(100)] + [(None, 1), (200, 9)]
    df = pairs_within(spark.createDataFrame(rows, "k long, s int").selectExpr("*", "k * 10 as v"), "s", "k", ["v"], block=5)
    got = sorted((r["x"]["k"], r["y"]["k"], r["x"]["v"], r["y"]["v"]) for r in df.collect())
    assert got == sorted((a, b, 10 * a, 10 * b) for a, s in rows for b, t in rows if None not in (a, b, s) and s == t and a < b)
    assert loops_of_a_task(df) == 1


def test_pair_evidence_of_odd_sizes_names_and_keys_equals_its_sql(spark, tmp_path):
    rows = [(k - 60, (None, "Red", "rEd", "navy", "")[k % 5], ("Tin", None, "tin", "STEEL")[k % 4], None if k % 11 == 0 else k * 7 % 60 - 5) for k in range(150)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_size int").selectExpr("*", "'B' as p_brand")
    con = over(spark, tmp_path, part=part)
    df = QUERIES["pair_evidence_audit"](spark, str(tmp_path))
    assert_same(df, con, SQL["pair_evidence_audit"])
    assert loops_of_a_task(df) == 1


def test_numbers_of_customers_meet_one_record_at_a_time_and_equal_their_sql(spark, tmp_path):
    con = over(spark, tmp_path, customer=spark.range(200).selectExpr("id * 1009 + 7 as c_custkey", "cast(nullif(id % 3, 2) as int) as c_nationkey"))
    df = QUERIES["phone_compare"](spark, str(tmp_path))
    assert_same(df, con, SQL["phone_compare"])
    assert loops_of_a_task(df) == 1


def test_scores_of_parts_meet_one_record_at_a_time_and_equal_their_sql(spark, tmp_path):
    con = over(spark, tmp_path, part=parts(spark, 150).selectExpr("p_partkey", "p_name", "p_type", "p_size", "if(p_partkey % 4 = 0, 'C', p_brand) as p_brand"))
    df = QUERIES["retrieval_score"](spark, str(tmp_path))
    assert_same(df, con, SQL["retrieval_score"])
    assert loops_of_a_task(df) == 1
