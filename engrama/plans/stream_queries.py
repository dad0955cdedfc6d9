"""Stateful operators over the given tables read as streams, each run until all that is there has been seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.session import shared_dir
from engrama.streaming import logs, telemetry

from .trace_queries import SQL as TRACE_SQL
from .vector_queries import r6


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; one that is a single file is picked out of its folder, as streams read folders."""
    path = f"{sf_dir}/{name}.parquet"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """What a stream has given once its sources are exhausted; complete results replace each other."""
    spark, out, checkpoint = stream.sparkSession, shared_dir(stream.sparkSession, "stream-out"), shared_dir(stream.sparkSession, "stream-state")
    write = "overwrite" if mode == "complete" else "append"
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda b, _: b.write.mode(write).parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.session_activity(_events(spark, sf_dir).where("ts is not null"), "user_id", gap="6 hours")
    return drained(s, "complete").select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", r6("total").alias("total"))


def stream_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = logs.windowed_counts(_events(spark, sf_dir).where("ts is not null"), "event_type", size="1 day")
    return drained(s, "complete").select(F.unix_micros("start").alias("start_us"), "event_type", "n", r6("total").alias("total"))


def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(logs.deduplicated(_events(spark, sf_dir).where("ts is not null")), "append").select("event_id", "user_id", "event_type")


def stream_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), (F.col("event_id") + 1).alias("id"))
    return drained(logs.running_tails(e), "complete")


def stream_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift monitor as a stateful stream; its rows equal those of drift_alerts."""
    stream = stream_table(spark, sf_dir, "embeddings")
    best = F.lit(1.0) / F.sqrt(1.0 + F.pow(0.3 * (F.col("vec_id") % 5), F.lit(2)))
    rows = stream.select(F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")).alias("session_id"), F.floor(F.col("vec_id") / 2).cast("long").alias("seq"), F.col("embedding").cast("array<double>").alias("qv"), best.alias("best_similarity"))
    out = drained(telemetry.monitored(rows), "append")
    return out.select("session_id", "seq", "hit", r6("hit_rate").alias("hit_rate"), F.round("drift", 8).alias("drift"), "alert")


QUERIES = {f.__name__: f for f in (stream_session_windows, stream_tumbling_counts, stream_deduplicated, stream_tails, stream_drift)}
SQL = {
    "stream_session_windows": """WITH e AS (SELECT user_id, epoch_us(ts) AS t, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, sum((b IS NULL OR t - b >= 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM g GROUP BY user_id, s""",
    "stream_tumbling_counts": "SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
    "stream_deduplicated": "SELECT event_id, user_id, event_type FROM events WHERE ts IS NOT NULL",
    "stream_drift": TRACE_SQL["drift_alerts"],
    "stream_tails": "SELECT 'u' || user_id AS session_id, max(event_id + 1) AS tail_id, count(*) AS n_events FROM events GROUP BY user_id",
}
