"""Streaming ingest of record drops: an extension, not part of the batch engine's semantics.

The projections are those of the batch functions; late repeats of a record are dropped under a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract
from ..sources.stores import RECORD_SCHEMA


def records(spark: SparkSession, path: str, delay: str = "10 minutes") -> DataFrame:
    """Records as they arrive in a folder of JSON lines, each id once within the delay, quarantined and cleaned."""
    raw = spark.readStream.schema(RECORD_SCHEMA).json(path)
    once = raw.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["record_id"])
    return once.withColumn("safe_text", extract.quarantined(F.col("text"))).withColumn("parsing_text", text.clean_for_parsing(F.col("safe_text"))).withColumn("n_instructions", extract.instruction_count(F.col("text")))


def counts(stream: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Records and quarantined instructions per language and window."""
    return stream.groupBy(F.window("timestamp", window), "language").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_instructions").alias("n_instructions"))
