"""Quality rules: counts within a document, and the frequency of its lines across the documents of its host.

A line is normalised (lower case, digits to 0, white space collapsed), hashed with its host, and
counted once for each document of that host that holds it. Two limits condemn a line: more than
`line_limit` documents hold it, and they have more than `text_limit` different texts, so that copies of
one document do not condemn each other. Condemned lines are removed; a document is depleted if they,
each as often as it stands there, leave less than `min_left` of the characters of its lines.

Cases at the edge: a null text has no words and fails; a null source is a host of its own; rows with one
doc_id and text are one document, and repeated rows get the same verdict; rows without a doc_id are one
document for each text; an empty table gives an empty result; other columns are not looked at, whatever
their names. Texts are told apart by two hashes (128 bits), lines by one of 64.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

WORD = re.compile(r"[^ \t-\r]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
LINE_LIMIT = 50
TEXT_LIMIT = 20
MIN_LEFT = 0.3


def repeated_words(hashes: np.ndarray, n: int = REPEAT_WINDOW) -> int:
    """Words inside any window of n words that the text holds twice or more, from the hashes of its words."""
    if len(hashes) <= n:
        return 0
    h = words.ngrams(hashes, n)
    _, place, counts = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[place] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif WORD.search(line):
            seen.add(line)
    return n


def base_counts(texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    return [
        (len(h), len(t) - sum(map(t.count, " \t\n\x0b\x0c\r")), sum(map(t.count, SYMBOLS)), duplicate_lines(t), repeated_words(h))
        for t, (h,) in zip(texts, words.by_text(texts), strict=True)
    ]


#: What tells the texts of a host apart.
CONTENT = ["c1", "c2"]


def content_key(host: str, text: str) -> list[Column]:
    """One key for each different text of a host."""
    h, t = F.coalesce(F.col(host), F.lit("\0")), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(h, t).alias("c1"), F.xxhash64(F.lit("second"), t, h).alias("c2")]


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), r"[ \t-\r]+", " "))


def host_lines(docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(c1, c2, line, docs, chars, rows): each normalised line of each different text of each host, once; how many
    documents hold it, its characters as often as it stands there, and how many rows begin with it."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), _normal)
    return (
        docs.select(*content_key(host, text), common.id_text(id_col).alias("d"), F.coalesce(F.col(host), F.lit("\0")).alias("h"), F.posexplode(lines).alias("pos", "l"))
        .where("l <> '' or pos = 0")
        .select(*CONTENT, "d", F.xxhash64("h", "l").alias("line"), F.length("l").alias("chars"), (F.col("pos") == 0).cast("long").alias("front"))
        .groupBy(*CONTENT, "line", "d").agg(F.sum("chars").alias("chars"), F.sum("front").alias("front"))
        .groupBy(*CONTENT, "line").agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").alias("chars"), F.sum("front").alias("rows"))
    )


def frequent_lines(lines: DataFrame, line_limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT) -> DataFrame:
    """Lines of a host that more documents and different texts hold than the limits allow."""
    counted = lines.where("chars > 0").groupBy("line").agg(F.sum("docs").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"))
    return counted.where((F.col("n_docs") > line_limit) & (F.col("n_texts") > text_limit)).select("line")


def depletion(docs: DataFrame, line_limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(c1, c2, chars_in_lines, chars_removed) of one row of each different text that loses a line."""
    lines = common.written(host_lines(docs, host, text, id_col), "lines")
    frequent = common.written(frequent_lines(lines, line_limit, text_limit), "frequent").withColumn("hit", F.lit(True))
    return (
        lines.join(common.checked(frequent), "line", "left")
        .groupBy(*CONTENT)
        .agg(F.sum("chars").alias("all"), F.sum(F.when(F.col("hit"), F.col("chars")).otherwise(0)).alias("gone"), F.sum("rows").alias("n"))
        .where("gone > 0")
        .select(*CONTENT, (F.col("all") / F.col("n")).cast("long").alias("chars_in_lines"), (F.col("gone") / F.col("n")).cast("long").alias("chars_removed"))
    )


def judge(docs: DataFrame, line_limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT, min_left: float = MIN_LEFT, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The counts, the base verdict and the final verdict of every row."""
    common.small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> dict:
        rows = base_counts(common.texts(batch, "t"))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return {"doc_id": batch.column("id"), "c1": batch.column("c1"), "c2": batch.column("c2")} | dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), map(list, cols), strict=True))

    counts = common.mapped(
        docs.select(F.col(id_col).alias("id"), *content_key(host, text), F.col(text).alias("t")),
        run,
        f"doc_id {kind}, c1 bigint, c2 bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint",
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = F.coalesce(1 - F.col("chars_removed") / F.col("chars_in_lines"), F.lit(1.0))
    return (
        counts.join(depletion(docs, line_limit, text_limit, host, text, id_col), CONTENT, "left")
        .withColumn("base_failed", failed)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & (left >= min_left)).alias("kept"), F.coalesce("chars_removed", F.lit(0)).cast("long").alias("line_chars_removed"))
    )


def clean(docs: DataFrame, line_limit: int = LINE_LIMIT, text_limit: int = TEXT_LIMIT, host: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with the lines above the limits taken out of their texts; all rows and columns stay."""
    frequent = common.written(frequent_lines(host_lines(docs, host, text, id_col), line_limit, text_limit), "frequent")
    lined = (
        docs.select(*content_key(host, text), F.coalesce(F.col(host), F.lit("\0")).alias("h"), F.col(text).alias("t"))
        .where(F.col("t").isNotNull())
        .dropDuplicates(CONTENT)
        .select(*CONTENT, "h", F.posexplode(F.split("t", "\n", -1)).alias("pos", "l"))
        .withColumn("line", F.xxhash64("h", _normal(F.col("l"))))
        .join(common.checked(frequent), "line", "left_anti")
        .groupBy(*CONTENT)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "l"))), lambda s: s["l"]), "\n").alias("new"))
    )
    names = {c: common.fresh(docs, f"_{c}") for c in [*CONTENT, "new"]}
    keyed = docs.withColumns({names[c]: k for c, k in zip(CONTENT, content_key(host, text), strict=True)})
    joined = keyed.join(lined.withColumnsRenamed(names), [names[c] for c in CONTENT], "left")
    return joined.select(*[F.when(F.col(text).isNotNull(), F.coalesce(names["new"], F.lit(""))).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
