"""The block index over a long timeline: blocks of consecutive vectors with their centroid, searched in two phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V

from .knn import best, knn

BLOCK = 1024
MAX_BLOCKS = 16


def blocked(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """vectors (seq, id, ts, v) with block_id = seq div size; seq counts from 0 without gaps."""
    return vectors.withColumn("block_id", F.floor(F.col("seq") / size).cast("long"))


def centroids(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block_id, n, first_ts, last_ts, sealed, v): v is the mean vector of the block.

    A block has at most size rows, so its sums are partial aggregates of (block, position) and nothing larger.
    """
    b = blocked(vectors, size)
    means = b.select("block_id", F.posexplode("v").alias("pos", "x")).groupBy("block_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy("block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    facts = b.groupBy("block_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return facts.withColumn("sealed", F.col("n") == size).join(means, "block_id")


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, blocks: int = 8, size: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank): the k best vectors within the blocks (16 at most) whose centroids are most similar."""
    index = centroids(vectors, size).select(F.col("block_id").alias("id"), "v")
    chosen = knn(queries, index, min(blocks, MAX_BLOCKS)).select("qid", F.col("id").alias("block_id"))
    asked = chosen.join(queries.select("qid", F.col("v").alias("qv")), "qid")
    hits = blocked(vectors, size).join(asked, "block_id").select("qid", "id", V.cosine("qv", "v").alias("score"))
    return best(hits, k)
