"""The queries of this subpackage, their SQL, and nothing else."""

from __future__ import annotations

from . import conversation_repair, decontamination, hmm_scoring, mixing, pii, quality_classifier, quality_rules, resharding, secret_scan, simhash_dedup, toxicity, vector_codes, warc_archive

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_toxicity": toxicity.query,
    "op3_decontamination": decontamination.query,
    "op4_hmm_scoring": hmm_scoring.query,
    "op5_resharding": resharding.query,
    "op6_quality_classifier": quality_classifier.query,
    "op7_pii": pii.query,
    "op8_simhash_dedup": simhash_dedup.query,
    "op9_secret_scan": secret_scan.query,
    "op10_mixing": mixing.query,
    "op11_vector_codes": vector_codes.query,
    "op12_conversation_repair": conversation_repair.query,
    "op13_warc_archive": warc_archive.query,
}
SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_decontamination": decontamination.SQL,
    "op9_secret_scan": secret_scan.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
    "op13_warc_archive": warc_archive.SQL,
}
