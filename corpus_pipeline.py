"""A pipeline from ``documents`` to packed training sequences.

Stages: documents rejected by the quality rules go; one document of each group of near copies stays; secrets are
replaced; sources are mixed to their target weights by repeating or leaving out documents; what remains is packed. Each
stage takes what its predecessor wrote, and all but the last return the columns they were given.

Rows are found again by id and hash of the text, so rows that repeat an id with another text keep their own verdict; rows
equal in both have one verdict, and stay one row after the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgraph.llm import jaccard, mixing, packing, quality, secrets
from fathomgraph.llm.common import table
from fathomgraph.llm.tokens import vocabulary_path
from fathomgraph.session import durable


def _keep(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id and hash of the text are in ``verdict``."""
    key = verdict.select(F.col("doc_id").alias("key_id"), F.col("text_key").alias("key_text")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("key_id")) & F.xxhash64("text").eqNullSafe(F.col("key_text"))
    return docs.join(key, on, "left_semi")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, quality.score_documents(docs).filter("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component; equal rows once. Rows without an id stay."""
    groups = jaccard.jaccard_groups(docs)
    stay = _keep(docs, groups.filter("component_id is null or doc_id = component_id"))
    return stay.withColumn("text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "text_key"]).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_secrets(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("source mixing", source_mix),
    ("packing", pack),
]

#: The language model, the Markov models and the packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
