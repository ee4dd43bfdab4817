"""The corpus queries and their SQL oracles."""

from __future__ import annotations

from palimpsest.llm import exact_dedup, fingerprints, jaccard_join, license_scan, line_dedup, mixing, sentencepieces, substring_dedup, toxicity, warc_fixity


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_warc_fixity": warc_fixity.op2_warc_fixity,
        "op3_sentencepieces": sentencepieces.op3_sentencepieces,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_license_scan": license_scan.op7_license_scan,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL expresses; ``tests/llm`` holds the others against plain versions in Python."""
    return {
        "op1_line_dedup": line_dedup.ORACLE_SQL,
        "op2_warc_fixity": warc_fixity.ORACLE_SQL,
        "op4_substring_dedup": substring_dedup.ORACLE_SQL,
        "op6_jaccard_join": jaccard_join.ORACLE_SQL,
        "op8_mixing": mixing.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    }
