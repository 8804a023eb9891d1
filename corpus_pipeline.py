"""A training corpus from raw documents, in five stages.

Toxic documents go, one document of each near-duplicate group stays, documents
that hold benchmark items go, secrets are masked, and what is left is packed
into sequences.  Every stage takes (spark, docs, sf_dir) and returns a
DataFrame; ``run`` writes each one as Parquet to the session's shared folder
and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from salesmart.llm import decontam, jaccard, packing, secret_scan, toxicity
from salesmart.llm.common import apart, table
from salesmart.session import cut


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    rows = apart(docs)      # a column of documents may be called score
    scored = toxicity.score_toxicity(rows, model, rows.columns)
    return scored.where("predicted = 0").select(*rows.columns).toDF(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id."""
    rows = apart(docs)
    return jaccard.jaccard_classes(rows).where("keeper").select(*rows.columns).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"), ["doc_id"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: fitted models, hashing and tokenisers have no SQL form; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
