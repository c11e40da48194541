"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from gleanery.llm import hard_negatives, imatch, jaccard, licenses, merkle, mixing, pieces, pii, quality_classifier, quality_rules, secret_scan, substring, toxicity


def queries() -> dict:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_pii": pii.op6_pii,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_mixing": mixing.op8_mixing,
        "op9_licenses": licenses.op9_licenses,
        "op10_fingerprints": imatch.op10_fingerprints,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_secret_scan": secret_scan.op13_secret_scan,
    }


def oracle_sql() -> dict:
    return {
        "op2_quality_rules": quality_rules.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    }
