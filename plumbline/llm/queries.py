"""The queries of this package and their SQL; the pipeline on top of it is corpus_pipeline at the repository's top."""

from __future__ import annotations

from . import bpe, chat, exact_dedup, html_extract, importance, interpolated_lm, jaccard_join, line_dedup, merkle, packing, pii, quality, shards


def queries() -> dict:
    return {
        "op1_html_extraction": html_extract.op1_html_extraction,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_mixture_packing": packing.op4_mixture_packing,
        "op5_byte_bpe": bpe.op5_byte_bpe,
        "op6_hypergeometric_shards": shards.op6_hypergeometric_shards,
        "op7_chat_format": chat.op7_chat_format,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_interpolated_lm": interpolated_lm.op9_interpolated_lm,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_personal_data": pii.op11_personal_data,
        "op12_importance_resampling": importance.op12_importance_resampling,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality.ORACLE,
        "op7_chat_format": chat.ORACLE,
        "op10_exact_dedup": exact_dedup.ORACLE,
        "op12_importance_resampling": importance.ORACLE,
        "op13_merkle_manifest": merkle.ORACLE,
    }
