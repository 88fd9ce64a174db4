"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of
documents; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenkg.llm import stages
from lumenkg.llm.common import delete_folder, shared_folder, table

STAGES = [
    ("quality rules", stages.quality_stage),
    ("toxicity", stages.toxicity_stage),
    ("near duplicates", stages.near_duplicate_stage),
    ("personal data", stages.mask_stage),
    ("packing", stages.packing_stage),
]

#: SQL cannot express the trained stages and the tokenizer; tests/llm/test_pipeline.py holds run() against a plain reckoning of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark)
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            delete_folder(spark, f"{folder}/{i - 1}")  # its successor is written
    return docs
