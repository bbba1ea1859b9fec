"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontam, jaccard_join, pii, quality, quality_rules, sentencepiece_codec, suffix_dedup, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_warc": warc.op3_warc,
        "op4_jaccard": jaccard_join.op4_jaccard,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_pii": pii.op6_pii,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_chat": chat.op9_chat,
        "op10_decontam": decontam.op10_decontam,
        "op10_proximity": decontam.op10_proximity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.OP3_SQL, "op9_chat": chat.OP9_SQL, "op10_decontam": decontam.OP10_SQL}
