"""Tiered queries and their telemetry: merging two tiers, cold misses, rolling hit rate, concept drift and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V

#: A query whose best similarity stays below is a cold miss; any other is a hit.
COLD = 0.65
RATE_WINDOW = 1000
MEAN_WINDOW = 100
LEAST_RATE = 0.70
MOST_DRIFT = 0.15


def merge_tiers(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """(qid, id, score, rank) of both tiers; of an id in both, the higher score."""
    both = local.select("qid", "id", "score").unionByName(cloud.select("qid", "id", "score")).groupBy("qid", "id").agg(F.max("score").alias("score"))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id")))


def cold_misses(queries: DataFrame, hits: DataFrame, threshold: float = COLD) -> DataFrame:
    """(qid, best, needs_cloud): whether the best score, at least 0, stays below the threshold; queries without hits do."""
    top = hits.groupBy("qid").agg(F.max("score").alias("top"))
    best = F.greatest(F.lit(0.0), F.coalesce("top", F.lit(0.0)))
    return queries.select("qid").join(top, "qid", "left").select("qid", best.alias("best"), (best < threshold).alias("needs_cloud"))


def tiered(queries: DataFrame, local: DataFrame, cloud: DataFrame, threshold: float = COLD) -> DataFrame:
    """(qid, id, score, rank, needs_cloud, hit): local answers, with those of the cloud merged in where local ones are cold.

    The cloud flag goes by the best local score, the hit flag by the best score after merging.
    """
    flags = cold_misses(queries, local, threshold)
    asked = cloud.join(flags.where("needs_cloud").select("qid"), "qid", "left_semi")
    merged = merge_tiers(local, asked).join(flags.select("qid", "needs_cloud"), "qid")
    return merged.withColumn("hit", F.max("score").over(W.partitionBy("qid")) >= threshold)


def rolling_hit_rate(rows: DataFrame, window: int = RATE_WINDOW) -> DataFrame:
    """Adds hit_rate over the last rows of a session (session_id, seq, hit)."""
    last = W.partitionBy("session_id").orderBy("seq").rowsBetween(1 - window, 0)
    return rows.withColumn("hit_rate", F.avg(F.col("hit").cast("double")).over(last))


def _by_position(rows: DataFrame) -> DataFrame:
    return rows.select("session_id", "seq", F.posexplode("qv").alias("pos", "x"))


def recent_mean(rows: DataFrame, window: int = MEAN_WINDOW) -> DataFrame:
    """(session_id, seq, pos, mean) of the last vectors, where there are as many as the window."""
    order = W.partitionBy("session_id", "pos").orderBy("seq")
    out = _by_position(rows).withColumn("n", F.row_number().over(order)).withColumn("mean", F.avg("x").over(order.rowsBetween(1 - window, 0)))
    return out.where(F.col("n") >= window).select("session_id", "seq", "pos", "mean")


def historical_centroid(rows: DataFrame) -> DataFrame:
    """(session_id, seq, pos, ema): the exponential mean with weight 2 / (n + 1), whose closed form is a cumulative sum.

    E_n = 2 / (n (n + 1)) * sum of k x_k, so no row waits for the one before.
    """
    order = W.partitionBy("session_id", "pos").orderBy("seq")
    out = _by_position(rows).withColumn("n", F.row_number().over(order).cast("double"))
    summed = F.sum(F.col("n") * F.col("x")).over(order.rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("ema", summed * 2.0 / (F.col("n") * (F.col("n") + 1))).select("session_id", "seq", "pos", "ema")


def drift(rows: DataFrame, window: int = MEAN_WINDOW) -> DataFrame:
    """(session_id, seq, drift): Jensen-Shannon divergence of the softmaxes of recent mean and historical centroid.

    0 while there are fewer rows than the window. Both means come from one shuffle by (session, position).
    """
    order = W.partitionBy("session_id", "pos").orderBy("seq")
    out = _by_position(rows).withColumn("n", F.row_number().over(order).cast("double"))
    summed = F.sum(F.col("n") * F.col("x")).over(order.rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("mean", F.avg("x").over(order.rowsBetween(1 - window, 0))).withColumn("ema", summed * 2.0 / (F.col("n") * (F.col("n") + 1)))
    out = out.groupBy("session_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "ema"))).alias("s"), F.max("n").alias("n"))
    p, q = F.transform("s", lambda x: x["mean"]), F.transform("s", lambda x: x["ema"])
    out = out.select("session_id", "seq", "n", V.softmax(p).alias("p"), V.softmax(q).alias("q"))
    return out.select("session_id", "seq", F.when(F.col("n") >= window, V.js_divergence("p", "q")).otherwise(F.lit(0.0)).alias("drift"))


def alerts(rows: DataFrame, hit: float = COLD) -> DataFrame:
    """(session_id, seq, hit, hit_rate, drift, alert) of rows (session_id, seq, qv, best_similarity)."""
    rated = rolling_hit_rate(rows.withColumn("hit", F.col("best_similarity") >= hit))
    n = F.row_number().over(W.partitionBy("session_id").orderBy("seq"))
    out = rated.withColumn("n", n).join(drift(rows), ["session_id", "seq"])
    alert = (F.col("n") >= MEAN_WINDOW) & ((F.col("hit_rate") < LEAST_RATE) | (F.col("drift") > MOST_DRIFT))
    return out.select("session_id", "seq", "hit", "hit_rate", "drift", alert.alias("alert"))


def inertia(turns: DataFrame, threshold: float) -> DataFrame:
    """(session_id, pairs, inertia): the share of consecutive turns (session_id, seq, v) more similar than the threshold."""
    order = W.partitionBy("session_id").orderBy("seq")
    pairs = turns.withColumn("before", F.lag("v").over(order)).where("before is not null")
    pairs = pairs.select("session_id", V.cosine("before", "v").alias("s"))
    return pairs.groupBy("session_id").agg(F.count("*").alias("pairs"), F.avg((F.col("s") > threshold).cast("double")).alias("inertia"))


def latency_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, deviation and discrete percentiles of value for each by."""
    exact = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(name) for p, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))]
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("stddev"), *exact)
