"""Benchmark decontamination: a positional inverted index of the corpus, asked from the rarest test terms.

DataFrame operations only. Test items are cut into windows of ten words (a shorter item is one window).
A first pass counts, over all documents, the terms that the windows hold; a window with a term that no
document has cannot occur. A second pass stores the postings (document, position) of the two rarest
terms of each window that is left, and of one end mark, whose position is the document's length. The
lists of the two terms, shifted by their places in the window, are intersected. The documents that are
left give postings of all their words, and the starts that are left are intersected with the shifted
lists of the window's other terms too; a start that is in all of them is an exact phrase. Terms that
stand nearly as far apart as in the item give the proximity matches.

The first passes fold letters with lower(), which folds more than the contract (A to Z) and moves no word
boundary, so they can only find more starts; the last intersection compares words folded by the contract.

Cases at the edge: a null text has no words; rows are told apart by two hashes (128 bits) of doc_id and
text, so repeated rows get equal results, and rows that share a doc_id but not a text are judged apart;
null item texts have no windows, a null item_id is left out of the items but its windows still hit; empty
tables give an empty result or no hits; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 10
#: Fixed value of the contract: what stands between words.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END_MARK = "\x01"


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS, -1), "")


def exact_words(text: str) -> Column:
    """The contract's words: A to Z folded, nothing else."""
    return _split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER))


def folded_words(text: str) -> Column:
    """The same words with all letters folded; as many, in the same places."""
    return _split(F.lower(F.coalesce(F.col(text), F.lit(""))))


#: What tells rows apart.
KEY = ["k1", "k2"]


def row_key(doc_id: str, text: str) -> list[Column]:
    own = common.id_text(doc_id)
    return [F.xxhash64(own, F.col(text)).alias("k1"), F.xxhash64(F.lit("second"), F.col(text), own).alias("k2")]


def windows(items: DataFrame, n: int = N) -> DataFrame:
    """(window, terms, item_ids): each different window once; window is a hash of its words."""
    cut = F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.slice("w", i, n))).when(F.size("w") > 0, F.array("w"))
    return (
        items.select("item_id", exact_words("text").alias("w"))
        .select("item_id", F.explode(cut).alias("terms"))
        .groupBy("terms")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .select(F.xxhash64("terms").alias("window"), "terms", "item_ids")
    )


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each of the terms stands in all documents."""
    said = docs.select(F.explode(folded_words("text")).alias("term"))
    return said.join(common.checked(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def rarest(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, length, t1, o1, t2, o2): each window's two rarest terms and their places, where every term occurs."""
    terms = wins.select("window", F.size("terms").alias("length"), F.posexplode(F.transform("terms", F.lower)).alias("at", "term"))
    return (
        terms.join(counts, "term")
        .groupBy("window", "length")
        .agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("s"))
        .where(F.size("s") == F.col("length"))
        .select("window", "length", F.col("s")[0]["term"].alias("t1"), F.col("s")[0]["at"].alias("o1"), F.get("s", F.lit(1))["term"].alias("t2"), F.get("s", F.lit(1))["at"].alias("o2"))
    )


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, k1, k2, doc_id, at) of the terms in all documents; the end mark's `at` is the document's length."""
    marked = F.array_append(folded_words("text"), F.lit(END_MARK))
    said = docs.select("doc_id", *row_key("doc_id", "text"), F.posexplode(marked).alias("at", "term"))
    wanted = terms.unionByName(docs.sparkSession.range(1).select(F.lit(END_MARK).alias("term")))
    return said.join(common.checked(common.written(wanted, "terms")), "term")


def starts(postings: DataFrame, rare: DataFrame) -> DataFrame:
    """(k1, k2, window, start, length): where the lists of a window's two rarest terms meet, each shifted by its place."""
    said = postings.select("term", *KEY, "at")
    first = said.withColumnRenamed("term", "t1").join(common.checked(rare), "t1").select(*KEY, "window", "length", (F.col("at") - F.col("o1")).alias("start"), "t2", (F.col("at") - F.col("o1") + F.col("o2")).alias("at2")).where("start >= 0")
    second = said.select(*KEY, F.col("term").alias("t2"), F.col("at").alias("at2"))
    columns = [*KEY, "window", "start", "length"]
    return first.where("t2 is null").select(*columns).unionByName(first.where("t2 is not null").join(second, [*KEY, "t2", "at2"], "left_semi").select(*columns)).distinct()


def in_all_lists(found: DataFrame, docs: DataFrame, wins: DataFrame) -> DataFrame:
    """The starts that are in the shifted lists of all terms of their windows."""
    keys = common.written(found.select(*KEY).distinct(), "keys")
    texts = docs.select(*row_key("doc_id", "text"), F.col("text").alias("t")).join(common.checked(keys), KEY, "left_semi").dropDuplicates(KEY)
    postings = texts.select(*KEY, F.posexplode(exact_words("t")).alias("at", "term"))
    terms = common.written(wins.select("window", F.posexplode("terms").alias("o", "term")), "window-terms")
    asked = found.join(common.checked(terms), "window").select(*KEY, "window", "start", "length", (F.col("start") + F.col("o")).alias("at"), "term")
    met = asked.join(postings, [*KEY, "at", "term"]).groupBy(*KEY, "window", "start", "length").agg(F.count(F.lit(1)).alias("n"))
    return met.where("n = length").drop("n")


def phrases(docs: DataFrame, items: DataFrame, n: int = N) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lengths, hits, windows): lengths has (k1, k2, doc_id, n_words) of every row, hits (k1, k2, window, start, length) of every exact phrase."""
    wins = common.written(windows(items, n), "windows")
    vocabulary = common.written(wins.select(F.explode(F.transform("terms", F.lower)).alias("term")).distinct(), "vocabulary")
    rare = common.written(rarest(wins, term_counts(docs, vocabulary)), "rarest")
    wanted = rare.select(F.explode(F.array_compact(F.array("t1", "t2"))).alias("term")).distinct()
    postings = common.written(index(docs, wanted), "postings")
    is_end = F.col("term") == END_MARK
    lengths = postings.where(is_end).select(*KEY, "doc_id", F.col("at").cast("long").alias("n_words"))
    found = common.written(starts(postings.where(~is_end), rare), "starts")
    return lengths, common.written(in_all_lists(found, docs, wins), "hits"), wins


def proximity(docs: DataFrame, items: DataFrame, slop: int = 3, n: int = N) -> DataFrame:
    """(k1, k2, item_id, at1, at2): places where a window's two rarest terms stand as far apart as in the item, give or take `slop`."""
    wins = common.written(windows(items, n), "windows")
    vocabulary = wins.select(F.explode(F.transform("terms", F.lower)).alias("term")).distinct()
    rare = common.written(rarest(wins, term_counts(docs, common.written(vocabulary, "vocabulary"))), "rarest").where("t2 is not null")
    wanted = rare.select(F.explode(F.array("t1", "t2")).alias("term")).distinct()
    postings = common.written(index(docs, wanted), "postings").where(F.col("term") != END_MARK)
    shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    first = postings.select(F.col("term").alias("t1"), *KEY, F.col("at").alias("at1")).join(common.checked(rare), "t1").withColumn("d", shift).withColumn("at2", F.col("at1") - F.col("o1") + F.col("o2") + F.col("d"))
    second = postings.select(F.col("term").alias("t2"), *KEY, F.col("at").alias("at2"))
    met = first.join(second, [*KEY, "t2", "at2"], "left_semi").where("at1 <> at2")
    items_of = common.written(wins.select("window", F.explode("item_ids").alias("item_id")), "window-items")
    return met.join(common.checked(items_of), "window").select(*KEY, "item_id", "at1", "at2").distinct()


def report(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """Words, hit words and items of every row."""
    lengths, hits, wins = phrases(docs, items, n)
    empty = F.sha2(F.lit(""), 256)
    runs = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    grow = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["to"], r["start"]))).cast("long").alias("n"), F.greatest(acc["to"], r["end"]).alias("to"))
    covered = hits.groupBy(*KEY).agg(runs.alias("r")).select(*KEY, F.aggregate("r", zero, grow, lambda acc: acc["n"]).alias("n_hit"))
    named = (
        hits.select(*KEY, "window").distinct().join(wins.select("window", F.explode("item_ids").alias("item_id")), "window")
        .groupBy(*KEY).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
        .select(*KEY, F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("ids"), ","), 256).alias("items_sha256"))
    )
    zeroed = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return lengths.join(covered, KEY, "left").join(named, KEY, "left").select("doc_id", "n_words", zeroed("n_hit"), zeroed("n_items"), F.coalesce("items_sha256", empty).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return report(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op10_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items that it nearly holds; beside op10_decontam, whose columns are those of its SQL."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    near = proximity(docs, common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    items = near.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("near_items"))
    rows = docs.select(*row_key("doc_id", "text"), "doc_id").join(items, KEY, "left")
    return rows.select("doc_id", F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near"), "near_items")


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a window of an item go."""
    _, hits, _ = phrases(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    names = [common.fresh(docs, k) for k in KEY]
    bad = common.written(hits.select(*[F.col(k).alias(name) for k, name in zip(KEY, names, strict=True)]).distinct(), "bad")
    keyed = docs.withColumns(dict(zip(names, row_key("doc_id", "text"), strict=True)))
    return keyed.join(common.checked(bad), names, "left_anti").select(*[f"`{c}`" for c in docs.columns])


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {N}) AS n, array_to_string(w[i:i + least(len(w), {N}) - 1], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {N} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN win USING (n, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(it.s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
