"""A corpus pipeline of five stages, from documents to packed training sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), works on all
that its predecessor kept and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents.  All stages but the last return the columns of
``documents``.  The pipeline is not expressible in SQL (trained scores, hashed shingles,
tokenised packing), so ``ORACLE_SQL`` is None and tests compare it with brute force.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import exact_dedup, mixing, packing, queries, simhash, toxicity
from quarry.llm.common import shared_folder, table
from quarry.session import ship

ORACLE_SQL = None
#: Bytes of rows that go to a Python worker at once.  Whole texts make long rows, and both the worker and the executor's
#: own buffers keep what their largest batch took for all stages that follow.
BATCH_BYTES = 4 << 20


def ready(spark: SparkSession) -> None:
    """Ship the package and bound the session's Arrow batches by ``BATCH_BYTES``; a bound that the session sets itself stays."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the bar; labels are learned from those that are not held out."""
    ready(spark)
    labelled = toxicity.with_labels(docs.filter(queries.fold(F.col("doc_id"), 3) != 1), table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, labelled, docs.columns, "__quarry_score")
    return scored.filter(F.col("__quarry_score") < queries.TOXIC_AT).drop("__quarry_score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each exact text, the one with the largest id."""
    ready(spark)
    return exact_dedup.surviving_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id."""
    ready(spark)
    return simhash.near_distinct(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ready(spark)
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the training sequences."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path(queries.WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written below the shared checkpoint folder."""
    folder, docs = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
