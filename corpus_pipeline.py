"""A corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import line_dedup, ngram_join, packing, quality, secrets
from tracklake.llm.common import shared_folder

STAGES = [
    ("quality rules", quality.quality_stage),
    ("line dedup", line_dedup.line_dedup_stage),
    ("n-gram Jaccard join", ngram_join.near_duplicates_stage),
    ("secret scans", secrets.secrets_stage),
    ("best-fit packing", packing.packing_stage),
]
#: No stage order that ends in packing by a tokenizer can be said in SQL; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
