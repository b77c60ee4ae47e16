"""A corpus pipeline: STAGES are applied to documents in order, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattiq.llm import decontam, jaccard, packing, quality, secret_scan
from lattiq.llm.common import Scratch

STAGES = [
    ("quality", quality.stage),
    ("jaccard", jaccard.stage),
    ("decontamination", decontam.stage),
    ("secrets", secret_scan.stage),
    ("packing", packing.stage),
]
#: No SQL twin: near-duplicate links and packing have no DuckDB form; tests/llm compare with a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
