"""A training corpus from documents: toxic ones go, one of each near-duplicate group stays, benchmark copies go, secrets are redacted, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkloom.llm import common, stages

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("secrets", stages.redact_secrets),
    ("packing", stages.pack_sequences),
]
ORACLE_SQL = None  # classifiers, sketches and a tokenizer are beyond SQL; tests/llm hold run() against brute force


def run(spark, sf_dir: str) -> DataFrame:
    """The packed pieces. Each stage's result is written, and what it needed for that goes; the last one is lazy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with common.scope() as keep:
            docs = keep(common.materialize(stage(spark, docs, sf_dir), f"stage-{name}"))
