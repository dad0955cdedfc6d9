"""Dreaming: when to consolidate, what to say about it, and the cycle itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V

from . import tree

DEAD_SHARE = 0.25
SUMMARY_CHARS = 250
#: So many texts of a character, joined by three, are over SUMMARY_CHARS.
SUMMARY_TEXTS = SUMMARY_CHARS // 4 + 2
BATCH = 500
LEAST_NODES = 10


def pressure(nodes: DataFrame, budget_mb: float, dim: int, metadata_bytes: int = 256) -> DataFrame:
    """(total, dead, dead_share, size_mb, should_dream): more than a quarter is dead, or the store exceeds its budget."""
    counts = nodes.agg(F.count("*").alias("total"), F.count_if(tree.is_dead()).alias("dead"))
    share = F.when(F.col("total") > 0, F.col("dead") / F.col("total")).otherwise(F.lit(0.0))
    size = F.col("total") * V.node_stride(dim, metadata_bytes, 4) / F.lit(1024.0 * 1024.0)
    return counts.select("total", "dead", share.alias("dead_share"), size.alias("size_mb"), ((share > DEAD_SHARE) | (size > budget_mb)).alias("should_dream"))


def clipped(text: Column) -> Column:
    return F.when(F.char_length(text) > SUMMARY_CHARS, F.concat(F.substring(text, 1, SUMMARY_CHARS), F.lit("..."))).otherwise(text)


def stub_summaries(texts: DataFrame, by: str, order: str) -> DataFrame:
    """(by, summary): texts that aren't empty, in order, joined by " | " and cut at 250 characters.

    Only the first 251 characters of each can show, and of one character with its separator no more than 64 texts, so no
    more is gathered; the limit by group is applied before the shuffle too.
    """
    head = texts.where("text <> ''").select(by, order, F.substring("text", 1, SUMMARY_CHARS + 1).alias("t"))
    head = head.withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy(order, "t"))).where(F.col("_k") <= SUMMARY_TEXTS)
    joined = head.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "t"))), lambda s: s["t"]), " | ").alias("s"))
    return joined.select(by, clipped(F.col("s")).alias("summary"))


def mean_vector(nodes: DataFrame) -> list[float]:
    """The normalised mean vector; one row for each position comes to the driver."""
    rows = nodes.select(F.posexplode(V.doubles("v")).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()
    length = sum(r["m"] ** 2 for r in rows) ** 0.5 + 1e-12
    return [r["m"] / length for r in rows]


def dream(nodes: DataFrame, batch: int = BATCH, least: int = LEAST_NODES) -> tuple[DataFrame, DataFrame]:
    """One cycle over live nodes 1 to batch: summary, consolidation, compaction. Returns the new nodes and a one-row report.

    With fewer than `least` nodes nothing happens.
    """
    spark = nodes.sparkSession
    before = nodes.agg(F.count("*"), F.count_if(tree.is_dead())).first()
    schema = "nodes_before long, dead_before long, consolidated long, nodes_after long, ran boolean"
    if before[0] < least:
        return nodes, spark.createDataFrame([(before[0], before[1], 0, before[0], False)], schema)
    ids = nodes.where((F.col("id") >= 1) & (F.col("id") <= batch) & ~tree.is_dead())
    text = ids.select(F.lit(0).alias("g"), "id", F.col("metadata").alias("text"))
    summary = stub_summaries(text, "g", "id").first()
    merged = tree.consolidate(nodes, ids.select("id"), mean_vector(ids), summary["summary"] if summary else "")
    after = tree.compact(merged).drop("old_id", "was_delta")
    report = spark.createDataFrame([(before[0], before[1], ids.count(), after.count(), True)], schema)
    return after, report
