"""The corpus pipeline: identify languages, drop near duplicates, mask personal data, mix sources
and pack.

Each stage works on what the one before it kept, as a table written and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import common, language, mixing, packing, pii, simhash

STAGES = [
    ("language", language.keep_identified),
    ("near_duplicates", simhash.keep_one),
    ("personal_data", pii.redacted),
    ("mixing", mixing.mixed),
    ("packing", packing.pack_documents),
]

# Language mixtures, SimHash components and best-fit rounds have no SQL form; tests compare
# the stages with brute force on small tables instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages kept."""
    folder = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
