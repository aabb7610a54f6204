"""The queries of this subpackage and their SQL, for the entry module."""

from . import decontaminate, language_id, license_scan, line_dedup, media_columns, minhash_join, oracles, sentencepiece_chunks, suffix_dedup, token_counts, toxicity


def queries():
    return {
        "op1_minhash_join": minhash_join.op1_minhash_join,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_license_scan": license_scan.op4_license_scan,
        "op5_media_columns": media_columns.op5_media_columns,
        "op6_language_id": language_id.op6_language_id,
        "op7_sentencepiece": sentencepiece_chunks.op7_sentencepiece,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_token_counts": token_counts.op9_token_counts,
    }


def oracle_sql():
    return {"op1_minhash_join": oracles.NEAR_DUPLICATES, "op8_decontamination": oracles.DECONTAMINATION, "op10_suffix_dedup": oracles.PASSAGES, "op2_line_dedup": line_dedup.ORACLE, "op4_license_scan": license_scan.oracle()}
