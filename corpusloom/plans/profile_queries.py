"""Queries over clusters of paragraphs: profiles of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import clusters
from ..sources.tables import assignments
from .registry import query

#: The stand-in assignment table: 50 papers, label 0 as noise.
ASSIGN = "SELECT vec_id AS para_id, vec_id % 50 AS paper_id, CASE WHEN label = 0 THEN -1 ELSE label END AS cluster FROM embeddings"


@query(
    f"""
    SELECT paper_id, count(*) AS total_paragraphs, count(*) FILTER (cluster = -1) AS noise_paragraphs,
           round(count(*) FILTER (cluster = -1) / count(*)::DOUBLE, 6) AS noise_ratio,
           count(DISTINCT cluster) FILTER (cluster <> -1) AS unique_clusters,
           count(*) FILTER (cluster <> -1) AS non_noise_paragraphs, bool_and(cluster = -1) AS isolate
    FROM ({ASSIGN}) GROUP BY paper_id
    """
)
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.profile(assignments(spark, sf_dir))
