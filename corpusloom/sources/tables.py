"""Readers of the base tables, and the tables that stand in for the entities of the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """para_id, paper_id, cluster of the embeddings: 50 papers, label 0 as noise (-1)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("para_id"),
        (F.col("vec_id") % 50).alias("paper_id"),
        F.when(F.col("label") == 0, -1).otherwise(F.col("label")).alias("cluster"),
    )
