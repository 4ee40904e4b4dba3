"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> documents of the same columns (the last: packed pieces).

Cases, in every stage: documents may have columns of any other names, which stay as they are; rows with a null
text or doc_id stay (a null text cannot be toxic, near another, contaminated or hold a secret); repeated rows are
treated alike; an empty table gives an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontaminate import contamination
from .minhash import near_duplicates
from .packing import pack
from .secrets import redact
from .toxicity import fit, held_out, keep_clean


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score is 0.5 or more go; the model learns from the labelled documents that are not held out. Without labels all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_clean(docs, fit(docs, labels.filter(~held_out("doc_id", 5, 0))))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the smallest doc_id stays, with all its rows."""
    with common.scope() as keep:
        found = near_duplicates(docs)
        gone = keep(common.materialize(found.filter(~F.col("kept")).select("doc_id").distinct(), "dropped"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or enough of one, go with all their rows."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(common.materialize(found.select("doc_id").distinct(), "contaminated"), "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars, where it is a column, follows the redacted text. No row goes."""
    out = redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, as `pack` gives them: a null text is an end id alone; other columns go."""
    return pack(docs)
