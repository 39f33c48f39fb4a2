"""From raw documents to packed training sequences, stage by stage.

All stages take null, empty and very long texts, null doc_ids, repeated rows, no
rows at all and columns of any name; each says below what becomes of them. Ties
are settled by doc_id and text alone, so that reruns agree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hazmill.llm import mixing, near_dedup, packing, quality, secrets
from hazmill.llm.common import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the default policy keeps, by the ledger's failure bits; null and empty texts go, equal rows stay or go alike."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class, that of the smallest doc_id; texts without words and rows without doc_id stay, equal rows of one doc_id become one, different texts of one doc_id all stay."""
    return near_dedup.deduplicated(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; secrets in its text are replaced; null texts stay null."""
    return secrets.redact_secrets(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to two times; a null source is a source; texts without words stay once at most."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every row's text in training sequences; a null or empty text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Near-duplicate classes and balanced samples are not SQL; tests hold each stage's rows on a small table against what it must keep.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
