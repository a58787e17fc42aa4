"""The queries of this subpackage, one for each operator."""

from swatchline.llm import bpe, filter_audit, impact_topk, language, lattice, license_scan, line_dedup, ngram_join, packing, quality, secret_scan, token_align, token_counts


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_license_scan": license_scan.op2_license_scan,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_lattice_near_dedup": lattice.op4_lattice_near_dedup,
        "op5_packing": packing.op5_packing,
        "op6_bpe": bpe.op6_bpe,
        "op7_ngram_join": ngram_join.op7_ngram_join,
        "op8_impact_topk": impact_topk.op8_impact_topk,
        "op9_secret_scan": secret_scan.op9_secret_scan,
        "op10_language_id": language.op10_language_id,
        "op11_token_align": token_align.op11_token_align,
        "op12_token_counts": token_counts.op12_token_counts,
        "op13_filter_audit": filter_audit.op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others; tests hold them against plain versions, libraries or held-out rows."""
    return {
        "op2_license_scan": license_scan.ORACLE_SQL,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op4_lattice_near_dedup": lattice.ORACLE_SQL,
        "op7_ngram_join": ngram_join.ORACLE_SQL,
        "op8_impact_topk": impact_topk.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
