"""Operators over cluster assignments (para_id, paper_id, cluster), where -1 is noise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = -1


def profile(assigned: DataFrame) -> DataFrame:
    """Per paper: paragraphs, noise, distinct clusters, and whether it is isolated (noise alone)."""
    noise = F.col("cluster") == NOISE
    return assigned.groupBy("paper_id").agg(
        F.count(F.lit(1)).alias("total_paragraphs"),
        F.count_if(noise).alias("noise_paragraphs"),
        F.round(F.count_if(noise) / F.count(F.lit(1)), 6).alias("noise_ratio"),
        F.count_distinct(F.when(~noise, F.col("cluster"))).alias("unique_clusters"),
        F.count_if(~noise).alias("non_noise_paragraphs"),
        F.bool_and(noise).alias("isolate"),
    )
