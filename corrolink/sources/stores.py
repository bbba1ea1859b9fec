"""Sources and sinks: JSON scans with a fixed schema, versioned collections, exports, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_SCHEMA = "record_id string, source_type string, language string, text string, display_name string, timestamp timestamp, provenance_metadata map<string,string>, reliability_metadata map<string,string>"
INCIDENT_SCHEMA = f"incident_id string, description string, records array<struct<{', '.join(c.replace(' ', ':', 1) for c in RECORD_SCHEMA.split(', '))}>>"
# Limits of one request, and the keys that exports leave out.
LIMITS = {"records": 250, "record_chars": 20_000, "request_chars": 1_000_000, "candidates": 10}
# Labels that no candidate may carry.
PROHIBITED_LABELS = ("confirmed_match", "identity_confirmed", "person_found", "guaranteed_match")
SENSITIVE_MAP_KEYS = ("original_value", "raw_prompt", "api_key", "authorization", "private_notes")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of records; a row that does not fit the schema stops the read."""
    return spark.read.schema(RECORD_SCHEMA).option("mode", "FAILFAST").json(path)


def read_incidents(spark: SparkSession, path: str) -> DataFrame:
    """A document of incidents, one row for each record with its incident."""
    doc = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(f"incidents array<struct<{', '.join(c.replace(' ', ':', 1) for c in INCIDENT_SCHEMA.split(', ', 2))}>>").json(path)
    return doc.select(F.explode("incidents").alias("i")).select("i.incident_id", "i.description", F.explode("i.records").alias("r")).select("incident_id", "description", "r.*")


def repeated_ids(records: DataFrame, scope: str, record: str) -> DataFrame:
    """Record ids that a scope holds more than once; must be empty."""
    return records.groupBy(scope, record).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def over_limits(records: DataFrame, scope: str, text: str) -> DataFrame:
    """Counts and lengths of each scope, and whether each limit holds."""
    sized = records.groupBy(scope).agg(F.count(F.lit(1)).alias("n_records"), F.max(F.length(text)).alias("longest"), F.sum(F.length(text)).alias("total"))
    return sized.withColumn("passes", (F.col("n_records") <= LIMITS["records"]) & (F.col("longest") <= LIMITS["record_chars"]) & (F.col("total") <= LIMITS["request_chars"]))


def coverage_gaps(fixture: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that lacks them."""
    a = fixture.join(assigned, key, "left_anti").select(key, F.lit("assignment").alias("lacks"))
    return a.unionByName(assigned.join(fixture, key, "left_anti").select(key, F.lit("fixture").alias("lacks")))


def latest(artifacts: DataFrame, keys: list[str], version: str, tie: str) -> DataFrame:
    """The last version of each key (an upsert store kept as appended rows)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc(tie))
    return artifacts.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def listed(artifacts: DataFrame, created: str, tie: str, limit: int) -> DataFrame:
    """The newest rows, between one and a thousand of them."""
    return artifacts.orderBy(F.desc(created), F.desc(tie)).limit(max(1, min(1000, limit)))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_new(spark: SparkSession, bundle: DataFrame, path: str, key: str, content: str | None = None) -> None:
    """Append rows whose key is not stored yet. With `content`, a stored key with other content stops the write."""
    if exists(spark, path):
        stored = spark.read.parquet(path)
        if content and not bundle.join(stored.select(key, F.col(content).alias("_stored")), key).where(~F.col(content).eqNullSafe(F.col("_stored"))).isEmpty():
            raise ValueError(f"a stored {key} has other {content}")
        bundle = bundle.join(stored.select(key), key, "left_anti")
    bundle.write.mode("append").parquet(path)


def upsert(spark: SparkSession, rows: DataFrame, path: str, version: str) -> None:
    """Append rows as the next version of their keys; `latest` reads the last one of each."""
    now = (spark.read.parquet(path).agg(F.max(version)).first()[0] or 0) + 1 if exists(spark, path) else 1
    rows.withColumn(version, F.lit(now).cast("long")).write.mode("append").parquet(path)


def looked_up(df: DataFrame, **wanted) -> DataFrame:
    """Rows with the given values; the filter reaches the scan."""
    for column, value in wanted.items():
        df = df.where(F.col(column).eqNullSafe(F.lit(value)))
    return df


def chain_tail(chain: DataFrame, run: str = "run") -> DataFrame:
    """(run, sequence, event_hash): the last event of each run, which the next one is chained to."""
    return chain.groupBy(run).agg(F.max_by("event_hash", "sequence").alias("event_hash"), F.max("sequence").alias("sequence"))


def replaced_runs(stored: DataFrame, fresh: DataFrame, run: str = "run") -> DataFrame:
    """The stored rows with those of the runs in `fresh` replaced whole."""
    return stored.join(fresh.select(run).distinct(), run, "left_anti").unionByName(fresh)


def unknown_fields(spark: SparkSession, path: str, known: set[str]) -> list[str]:
    """Top-level fields of a JSON document that a request may not have."""
    return sorted(set(spark.read.option("multiLine", True).json(path).columns) - known)


def scenario(records: DataFrame, ids: DataFrame, key: str = "record_id") -> DataFrame:
    """The records that a scenario, case or demo names."""
    return records.join(ids.select(key).distinct(), key, "left_semi")


def unassigned(truth: DataFrame, identity: str, under_specified: str) -> DataFrame:
    """Assignments that do not have exactly one of identity and under-specified; must be empty."""
    return truth.where(F.col(identity).isNotNull() == F.coalesce(under_specified, F.lit(False)))


def prohibited(labels: DataFrame, column: str) -> DataFrame:
    """Rows whose label claims an identity, in any case and with blanks or underscores; must be empty."""
    return labels.where(F.replace(F.lower(F.col(column)), F.lit(" "), F.lit("_")).isin(*PROHIBITED_LABELS))


def replay_stable(df: DataFrame, volatile: tuple[str, ...] = ("decision_id", "created_at")) -> DataFrame:
    """The columns that a replay must give again."""
    return df.drop(*volatile)


def pending(work: DataFrame, checkpoint: DataFrame, key: str) -> DataFrame:
    """Work that no successful checkpoint row covers."""
    return work.join(checkpoint.where("status = 'ok'").select(key), key, "left_anti")


def scrubbed(c: Column) -> Column:
    """A metadata map without its sensitive keys."""
    return F.map_filter(c, lambda k, v: ~F.lower(k).isin(*SENSITIVE_MAP_KEYS))


def text_hashes(records: DataFrame, scope: str, record: str, text: str) -> DataFrame:
    """Per scope the hash of its input: over the record ids and text hashes in order of id."""
    lines = F.concat_ws(":", F.col(record).cast("string"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    return records.groupBy(scope).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(record).alias("r"), lines.alias("l")))), lambda x: x["l"]), "\n"), 256).alias("input_hash"), F.count(F.lit(1)).alias("n_records"))


def assignment_digest(assigned: DataFrame, record: str, identity: str, scope: str) -> DataFrame:
    """Per scope the digest of its sorted `record -> identity` lines."""
    return assigned.groupBy(scope).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" -> ", F.col(record).cast("string"), F.col(identity).cast("string")))), "\n"), 256).alias("digest"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """Write json, csv or a Markdown table; array columns of a csv or table are joined by bars."""
    if kind == "md":
        cells = [F.coalesce(F.array_join(c, " / ") if t.startswith("array") else F.col(c).cast("string"), F.lit("")) for c, t in df.dtypes]
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.regexp_replace(c, r"[|\n]", " ") for c in cells]), F.lit(" |"))
        head = df.sparkSession.createDataFrame([(f"| {' | '.join(df.columns)} |",), (f"|{'-|' * len(df.columns)}",)], "value string")
        head.coalesce(1).write.text(f"{path}/head")
        df.select(row.alias("value")).write.text(f"{path}/rows")
    elif kind == "csv":
        df = df.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
        df.write.option("header", True).csv(path)
    elif kind == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown export kind {kind}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, n_bytes, sha256) of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
