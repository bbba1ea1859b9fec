"""Field keys, field policies and decision vocabulary: data, not code."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical keys, and the aliases of each.
KEYS = {
    "name": ("full_name", "full name", "person_name", "person name", "given_name", "surname", "family_name", "first_name", "last_name"),
    "aliases": ("alias", "nickname", "also_known_as"),
    "age": ("approximate_age", "estimated_age", "age_range"),
    "date_of_birth": ("dob", "birth_date", "birth date", "date of birth", "birthday", "born"),
    "government_id": ("id", "government id", "gov_id", "gov id", "national_id", "national id", "aid_id", "registration_number", "registration number", "identity_card", "id_number", "id number", "passport"),
    "phone": ("telephone", "phone_number", "phone number", "mobile", "cell", "cellphone", "contact_phone", "contact number", "tel"),
    "email": ("e-mail", "e_mail", "mail", "email_address", "email address", "contact_email"),
    "sex_gender": ("sex", "gender"),
    "language": ("languages", "spoken_languages"),
    "nationality": ("citizenship",),
    "physical_descriptors": (),
    "distinguishing_marks": ("distinctive_features", "distinctive features", "scars", "tattoos", "marks", "injury", "injuries", "medical_condition"),
    "clothing": ("clothing_description", "clothes", "garment", "wearing"),
    "family_member_names": ("family_member", "parent_name", "mother_name", "father_name", "sibling_names", "relative_names", "relatives"),
    "home_address": ("address", "residence", "home"),
    "last_known_location": ("last_seen_location", "location", "last seen", "seen_at"),
    "shelter_location": ("shelter", "hospital_location", "camp_location", "camp", "hospital"),
    "last_seen_time": ("timestamp", "datetime_last_seen", "time", "datetime"),
    "timeline_event": (),
}
RELATIONSHIPS = ("mother", "father", "parent", "sibling", "brother", "sister", "son", "daughter", "child", "spouse", "husband", "wife", "uncle", "aunt", "cousin", "grandmother", "grandfather", "guardian", "caretaker")
IDENTIFIER_HINTS = ("id", "identifier", "passport", "license", "card", "number", "phone", "tel", "mobile", "cell", "contact", "email", "mail", "dob", "birth", "birthday", "date", "address", "location", "home")
STRONG_KEYS = ("government_id", "phone", "email")
SENSITIVE_KEYS = ("name", "date_of_birth", "government_id", "phone", "email", "home_address")

# Certainty words, and the rank that transformations may not raise.
CERTAINTY_ALIASES = {
    "high": "exact", "high_confidence": "exact", "verbatim": "exact", "confirmed": "exact",
    "medium": "estimated", "medium_confidence": "estimated", "approximate": "estimated",
    "low": "inferred", "low_confidence": "inferred", "uncertain": "inferred",
    "unknown": "missing", "not_present": "missing",
}
CERTAINTY_RANK = {"missing": 0, "inferred": 1, "estimated": 2, "translated": 2, "exact": 3}


class Policy(NamedTuple):
    name: str
    keys: tuple[str, ...]
    comparator: str
    reliability: str
    weight: float
    blocks: bool = False  # whether disagreement under an exact comparator blocks linkage


# The policies, in the order in which fields are compared and scores added up.
POLICIES = (
    Policy("full_name", ("name",), "name", "moderate_discriminator", 0.12),
    Policy("date_of_birth", ("date_of_birth", "dob"), "date", "strong_discriminator", 0.18),
    Policy("age", ("age",), "age", "weak_discriminator", 0.08),
    Policy("government_id", ("government_id", "national_id", "aid_id", "registration_number"), "exact", "unique_identifier", 0.25, True),
    Policy("phone", ("phone", "phone_number", "contact_phone"), "phone", "strong_discriminator", 0.15),
    Policy("email", ("email", "email_address", "contact_email"), "email", "strong_discriminator", 0.10),
    Policy("sex_gender", ("sex", "gender", "sex_gender"), "exact", "weak_discriminator", 0.02),
    Policy("language", ("languages", "language"), "overlap", "weak_discriminator", 0.03),
    Policy("nationality", ("nationality",), "exact", "weak_discriminator", 0.02),
    Policy("physical_descriptors", ("physical_descriptors", "height", "build", "hair_color", "eye_color"), "overlap", "weak_discriminator", 0.03),
    Policy("distinguishing_marks", ("distinguishing_marks", "distinctive_features", "scars", "tattoos"), "overlap", "strong_discriminator", 0.10),
    Policy("clothing", ("clothing", "clothing_description"), "overlap", "weak_discriminator", 0.02),
    Policy("family_member_names", ("family_member_names", "parent_name", "mother_name", "father_name", "sibling_names", "relative_names"), "name", "moderate_discriminator", 0.08),
    Policy("home_address", ("home_address", "address", "residence"), "place", "moderate_discriminator", 0.05),
    Policy("last_known_location", ("last_known_location", "last_seen_location", "location"), "place", "contextual_only", 0.03),
    Policy("shelter_location", ("shelter_location", "shelter", "hospital_location", "camp_location"), "place", "contextual_only", 0.02),
    Policy("last_seen_time", ("last_seen_time", "timestamp", "datetime_last_seen", "time"), "time", "contextual_only", 0.03),
)
LINK_SCORE, REVIEW_SCORE, MIN_CATEGORIES = 0.35, 0.15, 2

# What a decision state means for classification, review and the reviewer.
STATES = ("link_recommended", "human_review_required", "insufficient_evidence", "do_not_link", "blocked_by_conflict", "system_error")
CLASSIFICATION = dict(zip(STATES, ("strong_candidate_for_review", "possible_candidate", "insufficient_evidence", "conflicting_evidence", "conflicting_evidence", "insufficient_evidence"), strict=True))
PRIORITY = dict(zip(STATES, ("high_priority_verification", "standard_verification", "request_more_information", "no_action_recommended", "urgent_conflict_review", "technical_failure"), strict=True))
ACTIONS = {
    "link_recommended": ("record_authorized_verification_outcome", "escalate_authorized_review", "request_more_information"),
    "human_review_required": ("request_more_information", "escalate_authorized_review", "dismiss_candidate"),
    "insufficient_evidence": ("request_more_information", "dismiss_candidate"),
    "do_not_link": ("dismiss_candidate", "mark_unrelated", "request_more_information"),
    "blocked_by_conflict": ("escalate_authorized_review", "request_more_information"),
    "system_error": ("escalate_authorized_review",),
}
#: States to which an adjudicator may move a deterministic decision.
TRANSITIONS = {
    "link_recommended": ("link_recommended", "human_review_required", "insufficient_evidence"),
    "human_review_required": ("human_review_required", "insufficient_evidence", "blocked_by_conflict"),
    "insufficient_evidence": ("insufficient_evidence",),
    "do_not_link": ("do_not_link", "blocked_by_conflict"),
    "blocked_by_conflict": ("blocked_by_conflict",),
    "system_error": ("system_error", "human_review_required", "insufficient_evidence"),
}


def mapped(c: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A lookup in a small fixed table."""
    out = F.lit(None).cast("string") if default is None else default
    for k, v in reversed(table.items()):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, key): every alias and every key itself."""
    rows = [(a, k) for k, aliases in KEYS.items() for a in (k, *aliases)]
    return spark.createDataFrame(rows, "alias string, key string")


def canonical_keys(fields: DataFrame, column: str = "raw_key") -> DataFrame:
    """fields with canonical_key, status and relationship_type. Unknown keys keep their rows and get no key."""
    aliases = F.broadcast(alias_table(fields.sparkSession))
    trimmed = F.trim(F.col(column))
    lookup = F.lower(trimmed)
    joined = fields.join(aliases, lookup == aliases["alias"], "left")
    hinted = F.lit(False)
    for hint in IDENTIFIER_HINTS:
        hinted = hinted | lookup.contains(hint)
    status = (
        F.when(trimmed.isin(*KEYS), "canonical")
        .when(F.col("key").isNotNull(), "normalized_by_alias")
        .when(lookup.isin(*RELATIONSHIPS), "relationship_key")
        .when(hinted, "unknown_review_required")
        .otherwise("unknown_retained")
    )
    key = F.when(F.col("key").isNotNull(), F.col("key")).when(lookup.isin(*RELATIONSHIPS), F.lit("family_member_names"))
    kept = [fields[c] for c in fields.columns]
    return joined.select(*kept, key.alias("canonical_key"), status.alias("status"), F.when(status == "relationship_key", lookup).alias("relationship_type"))


def certainty(c: Column) -> Column:
    """A certainty word as its category; unknown words give null."""
    word = F.replace(F.replace(F.lower(F.trim(c)), F.lit("-"), F.lit("_")), F.lit(" "), F.lit("_"))
    return mapped(word, CERTAINTY_ALIASES | {k: k for k in CERTAINTY_RANK})
