"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import byte_bpe, decontaminate, fingerprint, hard_negatives, jaccard_join, langid, license_scan, mixture, quality, spelling, substring_dedup, toxicity, warc_revisit

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_langid": langid.op2_langid,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_warc_revisit": warc_revisit.op4_warc_revisit,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_mixture": mixture.op6_mixture,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_byte_bpe": byte_bpe.op13_byte_bpe,
}

ORACLES: dict[str, str] = {
    "op4_warc_revisit": warc_revisit.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_mixture": mixture.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
