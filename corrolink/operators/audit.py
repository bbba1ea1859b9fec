"""Audit: a hash chain over the events of a run, and its verification without a sequential pass.

Hashing a chain is sequential inside a run and parallel across runs: a run's events are folded in order by
one higher-order function. Verification looks at each event and the one before it only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "0" * 64


def link(run: Column, sequence: Column, payload: Column, previous: Column) -> Column:
    """Hash of an event: over its run, number, payload hash and the hash before it."""
    return F.sha2(F.concat_ws("|", run.cast("string"), sequence.cast("string"), F.sha2(payload, 256), previous), 256)


def chained(events: DataFrame, run: str, order: list[str], payload: str) -> DataFrame:
    """(run, sequence, payload, previous_hash, event_hash) of every event; a run's events are held together."""
    numbered = events.groupBy(F.col(run).alias("run")).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(payload).alias("payload")))).alias("es"))
    start = F.struct(F.lit(0).alias("n"), F.lit(GENESIS).alias("last"), F.array().cast("array<struct<sequence:int,payload:string,previous_hash:string,event_hash:string>>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        n = acc["n"] + 1
        h = link(F.col("run"), n, e["payload"], acc["last"])
        row = F.struct(n.alias("sequence"), e["payload"].alias("payload"), acc["last"].alias("previous_hash"), h.alias("event_hash"))
        return F.struct(n.alias("n"), h.alias("last"), F.array_append(acc["out"], row).alias("out"))

    return numbered.select("run", F.inline(F.aggregate("es", start, step, lambda acc: acc["out"])))


def verified(chain: DataFrame) -> DataFrame:
    """Per run: status (verified, incomplete, broken), the first bad number (0 if none), how many events hold before it, missing and doubled numbers."""
    w = Window.partitionBy("run").orderBy("sequence", "event_hash")
    seen = chain.withColumn("before", F.coalesce(F.lag("event_hash").over(w), F.lit(GENESIS))).withColumn("bad", (F.col("previous_hash") != F.col("before")) | (F.col("event_hash") != link(F.col("run"), F.col("sequence"), F.col("payload"), F.col("previous_hash"))))
    per = chain.groupBy("run", "sequence").agg(F.count(F.lit(1)).alias("n")).groupBy("run").agg(F.max("sequence").alias("top"), F.collect_set("sequence").alias("have"), F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("sequence")))).alias("doubled"))
    gaps = per.withColumn("missing", F.array_sort(F.array_except(F.sequence(F.lit(1), "top"), "have"))).drop("have")
    broken = seen.groupBy("run").agg(F.count(F.lit(1)).alias("events"), F.min(F.when(F.col("bad"), F.col("sequence"))).alias("first_bad"))
    joined = gaps.join(broken, "run")
    holes = (F.size("missing") > 0) | (F.size("doubled") > 0)
    first_hole = F.array_min(F.concat("missing", "doubled"))
    return joined.select(
        "run",
        F.when(holes, "incomplete").when(F.col("first_bad").isNotNull(), "broken").otherwise("verified").alias("status"),
        F.when(holes, first_hole).otherwise(F.coalesce("first_bad", F.lit(0))).alias("first_invalid"),
        F.when(holes, first_hole - 1).when(F.col("first_bad").isNotNull(), F.col("first_bad") - 1).otherwise(F.col("events")).cast("long").alias("verified_events"),
        F.array_join("missing", ",").alias("missing"),
        F.array_join("doubled", ",").alias("doubled"),
    )


def replay_diff(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(checkpoint, status): each checkpoint's hash against the replayed one, both ways."""
    e, o = expected.withColumnRenamed("hash", "expected"), observed.withColumnRenamed("hash", "observed")
    status = F.when(F.col("expected").isNull(), "unexpected").when(F.col("observed").isNull(), "missing").when(F.col("expected") == F.col("observed"), "match").otherwise("diverged")
    return e.join(o, "checkpoint", "full").select("checkpoint", status.alias("status"))
