"""The log as a stream: appends with ids and chains, exactly once; tails; event-time windows; dreaming on a timer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from engrama.operators import dream, trace
from engrama.sources.store import Store


def appender(store_path: str, order: str = "seq") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: gives the rows of a batch (session_id, text, order, ...) the next ids and their prev_id.

    A batch lands in a folder of its own number and replaces what an attempt that failed has left there, so each row is in
    the log once. The log that a batch goes on from is that of smaller batch numbers.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        target = f"{store_path}/batch={number}"
        new = batch.select("session_id", "text", order)
        if new.isEmpty():
            return
        log = read_log(spark, store_path, number)
        rows = trace.append(log, new, order)
        last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        rows.where(F.col("id") > last).select("id", "session_id", "prev_id", "text").write.mode("overwrite").parquet(target)

    return run


def read_log(spark: SparkSession, store_path: str, before: int | None = None) -> DataFrame:
    """The log (id, session_id, prev_id, text), or that of the batches before one."""
    schema = "id long, session_id string, prev_id long, text string, batch int"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(store_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema).drop("batch")
    rows = spark.read.schema(schema).parquet(store_path)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def append_stream(stream: DataFrame, store_path: str, checkpoint: str, order: str = "seq", **trigger) -> StreamingQuery:
    return stream.writeStream.foreachBatch(appender(store_path, order)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_tails(stream: DataFrame) -> DataFrame:
    """(session_id, tail_id, n_events) kept up to date; for update mode."""
    return stream.groupBy("session_id").agg(F.max("id").alias("tail_id"), F.count("*").alias("n_events"))


def deduplicated(stream: DataFrame, id_col: str = "event_id", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Events once each, however often they come within the lateness."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([id_col])


def session_activity(stream: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """(key, start, end, n, total): sessions that end when nothing comes for the gap."""
    out = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def windowed_counts(stream: DataFrame, by: str, ts: str = "ts", size: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """(start, by, n, total) in tumbling or sliding windows."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = stream.withWatermark(ts, lateness).groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def dreaming(ticks: DataFrame, store: Store, budget_mb: float, dim: int, checkpoint: str, every: str = "30 seconds", **trigger) -> StreamingQuery:
    """On each batch of ticks, look at the pressure on the store and run a dream cycle if it is too high."""

    def run(_: DataFrame, __: int) -> None:
        at = store.snapshot()
        nodes = store.read(at)
        if dream.pressure(nodes, budget_mb, dim).first()["should_dream"]:
            store.publish(dream.dream(nodes)[0].select(*[f.name for f in nodes.schema]), at)

    return ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": every})).start()
