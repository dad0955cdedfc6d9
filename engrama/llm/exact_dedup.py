"""Exact deduplication against a persistent digest index, with DataFrame functions only.

The index is a table (digest, keep_id) bucketed and sorted by digest. New rows are reduced to one row per digest with a
partial aggregation, anti-joined with the index by sort-merge (the index side needs no shuffle), and the digests not yet
known are appended. Only digests and ids are shuffled, never texts.

Cases: a null text is an empty text. Of equal texts in one batch the smallest id stays (null ids count as larger than
any); of a text known from an earlier batch the row that stayed then stays, so that feeding a batch again changes nothing.
Rows with one id and different texts are told apart by their texts; fully equal rows with one id all count in group_size
and have the same kept. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, collapsed, stage


class DigestIndex:
    """A persistent set of text digests in the table named table, in the session's catalogue and warehouse."""

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64):
        self.spark, self.table, self.buckets = spark, table, buckets

    def known(self) -> DataFrame:
        if self.spark.catalog.tableExists(self.table):
            return self.spark.table(self.table)
        return self.spark.createDataFrame([], "digest binary, keep_id long")

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Add the texts of docs to the index; rows (id_col, keep_id, group_size, kept, digest), one for each row of docs.

        group_size counts the equal rows of this batch.
        """
        rows = stage(docs.select(F.col(id_col).cast("long").alias("_id"), F.unhex(F.sha2(collapsed(text_col), 256)).alias("digest")), "digests")
        total = rows.count()
        groups = rows.groupBy("digest").agg(F.min("_id").alias("first_id"), F.count("*").alias("group_size"))
        groups = stage(groups, "digest-groups")
        fresh = groups.join(self.known().hint("merge"), "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"))
        fresh = fresh.repartition(self.buckets, "digest")
        fresh.write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").format("parquet").saveAsTable(self.table)
        self.spark.catalog.refreshTable(self.table)
        kept = groups.join(self.known().hint("merge"), "digest").select("digest", "keep_id", "group_size")
        out = attach_groups(rows, kept, "digest", "group_size", total, "_id")
        return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}").dedup(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
