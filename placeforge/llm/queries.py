"""The queries of this subpackage, and SQL for those that SQL can express."""

from . import decontam, html_extract, langid, mixing, packing, simhash, substring_dedup, token_counts, toxicity, winnow


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.query,
        "op2_substring_dedup": substring_dedup.query,
        "op3_language_id": langid.query,
        "op4_source_mixing": mixing.query,
        "op5_fingerprints": winnow.query,
        "op6_simhash_near_dedup": simhash.query,
        "op7_token_packing": packing.query,
        "op8_html_extraction": html_extract.query,
        "op9_decontamination": decontam.query,
        "op10_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": substring_dedup.SQL, "op4_source_mixing": mixing.SQL, "op9_decontamination": decontam.SQL}
