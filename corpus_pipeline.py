"""From raw documents to packed training sequences.

Each stage's result is written as Parquet and read again as the next stage's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockweave.llm import pipeline_stages as stages
from stockweave.llm.common import stored

STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("suffix-array dedup", stages.repeated_strings),
    ("benchmark decontamination", stages.decontamination),
    ("packing", stages.packing),
]
ORACLE_SQL = None  # trained scores, near-duplicate classes and tokens are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
