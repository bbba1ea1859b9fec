"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrolink.llm import common
from corrolink.llm.decontam import decontam_stage
from corrolink.llm.jaccard_join import jaccard_stage
from corrolink.llm.pii import redact_stage
from corrolink.llm.quality import quality_stage
from corrolink.llm.sentencepiece_codec import encode_stage

STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("benchmark decontamination", decontam_stage),
    ("PII", redact_stage),
    ("SentencePiece encoding", encode_stage),
]

#: Training and piece search are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole table documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))  # noqa: B023
    return docs
