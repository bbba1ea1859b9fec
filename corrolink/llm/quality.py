"""Quality classifier: hashed word n-grams, logistic regression, FTRL updates, sparse dot products.

Features of a whole text, in three groups that each have length one: hashed words and word pairs;
hashed shapes of words (letters in lower or upper case, digits and signs, runs drawn together) and
pairs of shapes; and how often pairs of words or lines come again. Labels, lang, source and doc_id are
never among them. Training takes a bounded sample of the labelled rows, TRAIN_ROWS, the ones whose
hashed doc_id is smallest, from those whose crc32(doc_id) mod 5 is not 0.

Cases at the edge: a null or empty text is scored by the bias alone; a null doc_id counts as the
empty text when rows are held out; of several labels of one document the mean decides, 0.5 counting
as 1; null labels are left out; without labels every score is 0.5; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, linear, words

TRAIN_ROWS = 8_000
HELD_OUT_OF = 5
CUT = 0.3
PARAMS = linear.Params(bits=18, alpha=0.6, beta=0.3, l1=0.01, l2=0.05, epochs=4)

def _group(h: np.ndarray, salt: int, bits: int) -> linear.Row:
    idx, counts = np.unique((words.mix(h + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
    return idx, np.sqrt(counts / max(1, len(h)))


def _again(h: np.ndarray) -> float:
    s = np.sort(h)
    return float((s[1:] == s[:-1]).mean()) if len(h) > 1 else 0.0


def features(text: str, h: np.ndarray, shapes: np.ndarray, bits: int = PARAMS.bits) -> linear.Row:
    """From a text, the hashes of its words and those of their shapes: feature numbers and values."""
    if not len(h):
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    pairs = words.ngrams(h, 2)
    lines = [x for x in text.split("\n") if x.strip()]
    again = [_again(pairs), _again(words.ngrams(h, 5)), 1 - len(set(lines)) / max(1, len(lines)), float((h[1:] == h[:-1]).mean()) if len(h) > 1 else 0.0]
    i1, v1 = _group(np.concatenate([h, pairs]), 1, bits)
    i2, v2 = _group(np.concatenate([shapes, words.ngrams(shapes, 2)]), 2, bits)
    own = np.array([1, 2, 3, 4, 8 + min(7, len(h).bit_length())], dtype=np.uint64)
    i3 = (words.mix(own) >> np.uint64(64 - bits)).astype(np.int64)
    idx, place = np.unique(np.concatenate([i1, i2, i3]), return_inverse=True)
    return idx, np.bincount(place, np.concatenate([v1, v2, np.sqrt(again), [0.5]]), len(idx))


def all_features(texts: list[str], bits: int = PARAMS.bits) -> list[linear.Row]:
    return [features(t, h, s, bits) for t, (h, s) in zip(texts, words.by_text(texts, shapes=True), strict=True)]


def held_out(doc_id: str | Column) -> Column:
    return F.crc32(common.id_text(doc_id).cast("binary")) % HELD_OUT_OF == 0


def sampled_labels(labels: DataFrame, column: str, rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label): at most `rows` labelled ids that are not held out, by the hash of the id."""
    return (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.avg(column) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )


def training_rows(docs: DataFrame, sample: DataFrame, featurise) -> tuple[list[linear.Row], np.ndarray, np.ndarray]:
    """Features, label columns (a row each) and ids of the sampled documents; the sample bounds what comes to the driver."""
    names = [c for c in sample.columns if c != "doc_id"]
    kept = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(sample), "doc_id")

    def run(batch: pa.RecordBatch) -> dict:
        rows = featurise(common.texts(batch, "t"))
        return {"doc_id": batch.column("doc_id"), "idx": [r[0].astype(np.int32).tobytes() for r in rows], "val": [r[1].astype(np.float32).tobytes() for r in rows]} | {n: batch.column(n) for n in names}

    table = common.mapped(kept, run, "doc_id bigint, idx binary, val binary, " + ", ".join(f"{n} int" for n in names)).toArrow().sort_by("doc_id")
    rows = [(np.frombuffer(i.as_buffer(), dtype=np.int32), np.frombuffer(v.as_buffer(), dtype=np.float32)) for i, v in zip(table["idx"], table["val"], strict=True)]
    return rows, np.array([table[n].to_numpy() for n in names], dtype=np.float64).reshape(len(names), -1), table["doc_id"].to_numpy()


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", rows: int = TRAIN_ROWS, params: linear.Params = PARAMS) -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from the labelled rows that are not held out."""
    common.small_batches(docs.sparkSession)
    data, y, _ = training_rows(docs, sampled_labels(labels, column, rows), lambda t: all_features(t, params.bits))
    model = linear.train(data, y[0], params)
    del data
    common.give_back()  # the driver keeps the model alone
    return model


def scored(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], bits: int = PARAMS.bits, score: str = "_score") -> DataFrame:
    """The columns `keep` of docs and the score of the whole text of each row, in a column named `score`."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^bits floats, whatever the data
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batch: pa.RecordBatch) -> dict:
        weights, bias = held.value
        rows = all_features(common.texts(batch, "text"), bits)
        return {c: batch.column(c) for c in keep} | {score: linear.score(rows, weights, bias)}

    return common.mapped(docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, "text"])]), run, f"{kinds}`{score}` double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; it learns from the labels of the documents given."""
    model = train(docs, common.table(spark, sf_dir, "labels"))
    score = common.fresh(docs, "_score")
    return scored(docs, model, docs.columns, score=score).where(F.col(score) >= CUT).select(*[f"`{c}`" for c in docs.columns])
