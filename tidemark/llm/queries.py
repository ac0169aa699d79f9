"""The queries of this subpackage, by name, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import bpe, exact_dedup, html, language, licenses, line_dedup, near_dedup, packing, quality, toxicity


def queries() -> dict:
    return {
        "op1_minhash_line_dedup": line_dedup.query,
        "op2_byte_bpe": bpe.query,
        "op3_compression_toxicity": toxicity.query,
        "op4_cutting_stock_packing": packing.query,
        "op5_license_scan": licenses.query,
        "op7_bag_minhash_near_dedup": near_dedup.query,
        "op8_recurrent_html_extraction": html.query,
        "op9_segmentation_language_id": language.query,
        "op10_isolation_forest_quality": quality.query,
        "op6_streaming_exact_dedup": exact_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_license_scan": licenses.ORACLE,
        "op6_streaming_exact_dedup": exact_dedup.ORACLE,
    }
