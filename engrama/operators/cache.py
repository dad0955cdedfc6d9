"""The similarity cache: its content after a log of inserts, lookups in two levels, and navigation behind it.

Lookups do not refresh entries, so after any log of inserts the cache is the `slots` distinct nodes inserted last, each with
its latest vector: an aggregation and a rank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V
from engrama.session import stage

from .knn import knn

SLOTS = 64
GLOBAL_SLOTS = 256
HIT = 0.85
SESSIONS = 64 * 1000


def snapshot(inserts: DataFrame, slots: int = SLOTS, by: str | None = None) -> DataFrame:
    """(by, node_id, v, tick) in the cache after inserts (tick, node_id, v): the latest slots nodes, for each value of by."""
    keys = [by] if by else []
    latest = inserts.groupBy(*keys, "node_id").agg(F.max("tick").alias("tick"), F.max_by("v", "tick").alias("v"))
    if by:
        order = W.partitionBy(by).orderBy(F.desc("tick"), "node_id")
        return latest.withColumn("k", F.row_number().over(order)).where(F.col("k") <= slots).drop("k")
    return latest.orderBy(F.desc("tick"), "node_id").limit(slots)


def lookup(queries: DataFrame, cache: DataFrame, threshold: float = HIT) -> DataFrame:
    """(qid, id, score, hit) of the most similar cached node; hit: the score reaches the threshold."""
    found = knn(queries.select("qid", "v"), cache.select(F.col("node_id").alias("id"), "v"), 1)
    return found.select("qid", "id", "score", (F.col("score") >= threshold).alias("hit"))


def two_level_lookup(queries: DataFrame, inserts: DataFrame, threshold: float = HIT) -> DataFrame:
    """(qid, level, id, score): a hit in the session's cache (1), else in the global one (2), else a miss (level 0)."""
    first = snapshot(inserts, SLOTS, "session_id")
    own = queries.join(first.select("session_id", "node_id", F.col("v").alias("cv")), "session_id").select("qid", F.col("node_id").alias("id"), V.cosine("v", "cv").alias("score"))
    own = own.groupBy("qid").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("a"))
    own = own.where(F.col("a.score") >= threshold)
    second = lookup(queries, snapshot(inserts, GLOBAL_SLOTS), threshold).where("hit").select("qid", F.struct("id", "score").alias("b"))
    out = queries.select("qid").join(own, "qid", "left").join(second, "qid", "left")
    level = F.when(F.col("a").isNotNull(), 1).when(F.col("b").isNotNull(), 2).otherwise(0)
    hit = F.coalesce("a", "b")
    return out.select("qid", level.alias("level"), hit["id"].alias("id"), hit["score"].alias("score"))


def live_sessions(touches: DataFrame, most: int = SESSIONS) -> DataFrame:
    """Sessions kept after touches (session_id, tick): those touched last."""
    return touches.groupBy("session_id").agg(F.max("tick").alias("tick")).orderBy(F.desc("tick"), "session_id").limit(most)


def navigate_cached(queries: DataFrame, inserts: DataFrame, answer: Callable[[DataFrame], DataFrame], threshold: float = HIT) -> DataFrame:
    """(qid, level, id, score, rank): a query (qid, session_id, v) that hits a cache is answered by that node alone (level 1
    or 2); the others (level 0) go to answer, which takes them and returns (qid, id, score, rank), and to it only."""
    found = stage(two_level_lookup(queries, inserts, threshold), "cache-lookups")
    hits = found.where("level > 0").select("qid", "level", "id", "score", F.lit(1).alias("rank"))
    missed = answer(queries.join(found.where("level = 0").select("qid"), "qid", "left_semi"))
    return hits.unionByName(missed.select("qid", F.lit(0).alias("level"), "id", "score", "rank"))


def occupied(inserts: DataFrame, slots: int = SLOTS, by: str | None = None) -> DataFrame:
    """(by, occupied): how many slots are in use, for each value of by, or in all."""
    held = snapshot(inserts, slots, by)
    return (held.groupBy(by) if by else held.groupBy()).agg(F.count("*").alias("occupied"))
