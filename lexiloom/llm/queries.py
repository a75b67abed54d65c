"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import language_id, mixing, near_join, nearest, packing, quality_model, quality_rules, substring_dedup, token_counts, warc


def queries() -> dict:
    return {
        "op1_quality_model": quality_model.op1_quality_model,
        "op2_nearest": nearest.op2_nearest,
        "op3_mix_sources": mixing.op3_mix_sources,
        "op4_pack": packing.op4_pack,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_near_join": near_join.op6_near_join,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_language_id": language_id.op9_language_id,
        "op10_warc_round_trip": warc.op10_warc_round_trip,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mix_sources": mixing.OP3_SQL,
        "op4_pack": packing.OP4_SQL,
        "op5_quality_rules": quality_rules.OP5_SQL,
        "op6_near_join": near_join.OP6_SQL,
        "op8_substring_dedup": substring_dedup.OP8_SQL,
        "op10_warc_round_trip": warc.OP10_SQL,
    }
