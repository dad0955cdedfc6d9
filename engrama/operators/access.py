"""Access layers: rows that the caller may not see are filtered before anything is scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knn import knn


def prefiltered_knn(queries: DataFrame, nodes: DataFrame, layers: list[str], k: int) -> DataFrame:
    """Top k among the rows of the layers given; the filter stands below the scoring and reaches the scan."""
    return knn(queries, nodes.where(F.col("layer_id").isin(layers)), k)


def postfiltered_knn(queries: DataFrame, nodes: DataFrame, layers: list[str], k: int) -> DataFrame:
    """Top k of all rows, of which those in the layers are shown: what not to do, kept to show the difference."""
    allowed = nodes.where(F.col("layer_id").isin(layers)).select("id")
    return knn(queries, nodes, k).join(allowed, "id", "left_semi").select("qid", "id", "score", "rank")
