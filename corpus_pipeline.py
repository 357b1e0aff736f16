"""The corpus pipeline: documents through five of the training-data operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as
Parquet in the shared checkpoint folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from riskloom.llm import decontaminate, minhash, quality_classifier, secrets, sentencepiece_codec
from riskloom.llm.common import load, saved

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("minhash_near_dedup", minhash.stage),
    ("benchmark_decontamination", decontaminate.stage),
    ("secret_scans", secrets.stage),
    ("sentencepiece", sentencepiece_codec.stage),
]

# The classifier's fit, the signatures and the merges have no SQL form; tests/llm
# compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
