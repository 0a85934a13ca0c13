"""Queries of this subpackage, by contract name, and the SQL of those that SQL can express."""

from __future__ import annotations

from strandex.llm import line_spread, lm_score, mixing, near_dup, packing, pii, quality, telephony, toxicity, warc_zip


def queries() -> dict:
    return {
        "op1_swap_packing": packing.op1_swap_packing,
        "op2_attention_lm": lm_score.op2_attention_lm,
        "op3_telephony_media": telephony.op3_telephony_media,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_quality_llr": quality.op5_quality_llr,
        "op6_line_spread": line_spread.op6_line_spread,
        "op7_toxic_lexicon": toxicity.op7_toxic_lexicon,
        "op8_lsh_forest": near_dup.op8_lsh_forest,
        "op9_bilstm_crf_pii": pii.op9_bilstm_crf_pii,
        "op10_warc_zip": warc_zip.op10_warc_zip,
    }


def oracle_sql() -> dict:
    return {"op4_source_mixing": mixing.ORACLE, "op6_line_spread": line_spread.ORACLE, "op10_warc_zip": warc_zip.ORACLE}
