"""The corpus operators' queries and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import chunk_store, mixing, near_dups, pu_quality, quality_rules, rans_codec, spm_codec, substring_dedup, suffix_dedup, token_counts


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_near_dups": near_dups.op2_near_dups,
        "op3_rans_tokens": rans_codec.op3_rans_tokens,
        "op4_chunk_media": chunk_store.op4_chunk_media,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_mix_sources": mixing.op8_mix_sources,
        "op9_sentencepiece": spm_codec.op9_sentencepiece,
        "op10_pu_quality": pu_quality.op10_pu_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.op1_sql(),
        "op2_near_dups": near_dups.OP2_SQL,
        "op5_suffix_dedup": suffix_dedup.OP5_SQL,
        "op7_substring_dedup": substring_dedup.OP7_SQL,
        "op8_mix_sources": mixing.OP8_SQL,
    }
