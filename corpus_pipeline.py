"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Packing takes the ids of a tokenizer and the near-duplicate stage follows links to components of any depth, so no SQL
text states the result (``ORACLE_SQL``); tests hold every stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralith.llm import stages

STAGES = stages.STAGES
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run_stages(spark, sf_dir)
