"""Claims of a candidate pair, their lineage to extracted facts, and the release of a case.

A claim cites spans. Extracted facts cite one each; every other claim descends from the extracted facts of
the spans that it cites, or, citing none that was extracted, from the first fact of each of its records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields whose spans a timeline claim cites, the ranks of certainty, and that of a claim without spans.
TIMELINE_FIELDS = ("time", "timeline", "location")
INFERRED = 1


def claim_id(candidate: Column, kind: Column, discriminator: Column) -> Column:
    """A name that depends on what is claimed alone."""
    text = F.concat_ws("|", candidate.cast("string"), kind, discriminator.cast("string"))
    return F.concat(F.lit("CLAIM-"), F.upper(F.substring(F.sha2(text, 256), 1, 12)))


def span_support(spans: DataFrame, records: DataFrame) -> DataFrame:
    """spans (span, record, field, quote, start, end, certainty) with language, supported, validation_status and content_hash.

    A span is supported if its offsets lie in its record's text and hold its quote. The hash covers the
    citation alone, as JSON with sorted keys. records: (record, source_text, language).
    """
    joined = spans.join(records, "record", "left")
    inside = F.col("source_text").isNotNull() & (F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= F.length("source_text"))
    holds = F.coalesce(inside & (F.expr("substring(source_text, start + 1, end - start)") == F.col("quote")), F.lit(False))
    cited = F.to_json(F.struct("end", "language", F.col("quote").alias("quotation"), F.col("record").cast("string").alias("source_document_id"), "start"))
    return joined.select(*spans.columns, "language", holds.alias("supported"), F.when(holds, "valid").otherwise("invalid").alias("validation_status"), F.sha2(cited, 256).alias("content_hash"))


def cited(candidates: DataFrame, spans: DataFrame, fields: DataFrame, factors: DataFrame, conflicts: DataFrame, rivals: DataFrame) -> DataFrame:
    """(candidate, claim_type, discriminator, span): a row for each span that a claim cites, one without span for a claim that cites none.

    candidates: candidate, a, b, has_timeline. fields: record, field_id, span of normalised values. factors: candidate,
    factor, span. conflicts: candidate, conflict, spans. rivals: candidate, record.
    """
    pair = candidates.select("candidate", F.explode(F.array("a", "b")).alias("record"))
    near = pair.unionByName(rivals.select("candidate", "record")).distinct()
    of = lambda kind, disc: ["candidate", F.lit(kind).alias("claim_type"), F.col(disc).cast("string").alias("discriminator"), "span"]
    known = spans.select("span")
    told = lambda df: df.join(known.withColumn("is_known", F.lit(True)), "span", "left").withColumn("span", F.when(F.col("is_known"), F.col("span")))
    timed = spans.where(F.lower("field").isin(*TIMELINE_FIELDS)).select("record", "span")
    timeline = candidates.where("has_timeline").select("candidate").join(pair.join(timed, "record"), "candidate", "left").withColumn("d", F.lit("timeline"))
    against = conflicts.select("candidate", "conflict", F.explode_outer("spans").alias("span"))
    return (
        near.join(spans.select("record", "span"), "record").select(*of("extracted_fact", "span"))
        .unionByName(near.join(fields, "record").join(known, "span").select(*of("normalized_representation", "field_id")))
        .unionByName(told(factors).select(*of("compatibility_claim", "factor")))
        .unionByName(timeline.select(*of("timeline_interpretation", "d")))
        .unionByName(told(against).select(*of("contradiction_claim", "conflict")))
        .unionByName(rivals.join(spans.select("record", "span"), "record", "left").select(*of("rival_comparison_claim", "record")))
    )


def built(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """(candidate, claim, claim_type, n_spans, supported, rank, parents) from the rows of `cited`.

    A claim is as certain as its least certain span and supported if all its spans are. spans: span, record, supported, rank.
    """
    named = rows.withColumn("claim", claim_id(F.col("candidate"), F.col("claim_type"), F.col("discriminator")))
    told = named.join(spans.select("span", "record", "supported", "rank"), "span", "left")
    claims = told.groupBy("candidate", "claim", "claim_type").agg(
        F.count("span").alias("n_spans"), F.coalesce(F.bool_and("supported"), F.lit(True)).alias("supported"), F.coalesce(F.min("rank"), F.lit(INFERRED)).alias("rank")
    )
    facts = told.where("claim_type = 'extracted_fact'").select("candidate", "span", "record", F.col("claim").alias("parent"))
    derived = told.where("claim_type <> 'extracted_fact'").select("candidate", "claim", "span", "record")
    by_span = derived.join(facts.drop("record"), ["candidate", "span"]).groupBy("candidate", "claim").agg(F.array_sort(F.collect_set("parent")).alias("own"))
    first = facts.groupBy("candidate", "record").agg(F.min_by("parent", "span").alias("parent"))
    by_record = derived.join(first, ["candidate", "record"]).groupBy("candidate", "claim").agg(F.array_sort(F.collect_set("parent")).alias("near"))
    lineage = claims.join(by_span, ["candidate", "claim"], "left").join(by_record, ["candidate", "claim"], "left")
    return lineage.select("candidate", "claim", "claim_type", "n_spans", "supported", "rank", F.array_join(F.coalesce("own", "near", F.array().cast("array<string>")), ",").alias("parents"))


def with_fallback(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """(case, candidate, classification): the candidates of each case, or one row NO-CANDIDATE that has insufficient evidence."""
    joined = cases.select("case").join(candidates.select("case", "candidate", "classification"), "case", "left")
    return joined.select("case", F.coalesce("candidate", F.lit("NO-CANDIDATE")).alias("candidate"), F.coalesce("classification", F.lit("insufficient_evidence")).alias("classification"))


def release_state(contracts: DataFrame, chains: DataFrame) -> DataFrame:
    """(case, n_contracts, state, blocking_rules): a case is released to review if all its contracts are and its audit chain is verified.

    contracts: case, contract, released, blocked_rules (array). chains: case, status.
    """
    per = contracts.groupBy("case").agg(F.count(F.lit(1)).alias("n_contracts"), F.bool_and("released").alias("all_released"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("blocked_rules")))).alias("rules"))
    released = F.col("all_released") & (F.coalesce("status", F.lit("")) == "verified")
    return per.join(chains.select("case", "status"), "case", "left").select(
        "case", "n_contracts", F.when(released, "authorized_review_required").otherwise("contract_blocked").alias("state"), F.when(released, "").otherwise(F.array_join("rules", ",")).alias("blocking_rules")
    )
