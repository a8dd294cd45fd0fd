"""The corpus pipeline: language ID, near-duplicate removal, PII redaction, source mixing, sequence packing.

Every stage works on all rows that its predecessor kept. Between stages the rows are written as Parquet in the shared
folder and read again, so a lost executor costs at most the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common, jaccard_join, language_id, mixing, packing, pii

STAGES = [
    ("language_id", language_id.stage),
    ("jaccard_join", jaccard_join.stage),
    ("pii", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Trained models and tokenizers are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
