"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from riskloom.llm import (
    centroids,
    decontaminate,
    embedding_dedup,
    license_scan,
    minhash,
    pii,
    quality_classifier,
    quality_rules,
    secrets,
    sentencepiece_codec,
    sharding,
    substring_dedup,
    vector_codes,
)

QUERIES = {
    "op1_license_scans": license_scan.query,
    "op2_sentencepiece": sentencepiece_codec.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_secret_scans": secrets.query,
    "op5_sharding": sharding.query,
    "op6_pii_surrogates": pii.query,
    "op7_minhash": minhash.query,
    "op8_quality_classifier": quality_classifier.query,
    "op9_quality_rules": quality_rules.query,
    "op10_decontamination": decontaminate.query,
    "op11_vector_codes": vector_codes.query,
    "op12_centroids": centroids.query,
    "op13_embedding_dedup": embedding_dedup.query,
}
ORACLES = {
    "op1_license_scans": license_scan.ORACLE,
    "op4_secret_scans": secrets.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_centroids": centroids.ORACLE,
    "op13_embedding_dedup": embedding_dedup.ORACLE,
}
