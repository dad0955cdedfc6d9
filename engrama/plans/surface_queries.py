"""Inserts with their checks, and the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama import sql
from engrama.operators import tree

from . import fixtures as fx
from .fixtures import with_
from .vector_queries import r6


def insert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta rows are inserted again, each under the node of half its id."""
    base, delta = fx.split_delta(spark, sf_dir)
    new = delta.select(F.col("id").alias("seq"), F.floor(F.col("id") / 2).cast("long").alias("parent_id"), "v", "metadata")
    return tree.insert(base, new, 64).select("id", "parent_id", "metadata", r6(F.element_at("v", 1)).alias("p0"))


def insert_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta rows in two goes; each third vector has lost its last number, and is stored as zeros."""
    _, delta = fx.split_delta(spark, sf_dir)
    cut = F.when(F.col("id") % 3 == 0, F.slice("v", 1, 63)).otherwise(F.col("v"))
    rows = delta.select(F.col("id").alias("seq"), cut.alias("v"), "metadata")
    none = delta.where("false")
    bound = delta.agg(F.min("id") + 10).first()[0]
    one = tree.insert_delta(none, rows.where(F.col("seq") < bound), 64)
    two = tree.insert_delta(one, rows.where(F.col("seq") >= bound), 64)
    return two.select("id", r6(F.element_at("v", 1)).alias("p0"))


def sql_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions in plain SQL over the store's views."""
    sql.register(spark, fx_nodes=fx.nodes(spark, sf_dir), fx_asked=fx.asked(spark, sf_dir))
    return spark.sql("SELECT q.qid, round(vector_cosine(q.qv, n.v), 6) AS cosine, round(quant_scale(n.v), 9) AS scale, is_dead(n.flags) AS dead FROM fx_asked q JOIN fx_nodes n ON n.id = q.qid + 3")


QUERIES = {f.__name__: f for f in (insert_nodes, insert_delta, sql_surface)}
SQL = {
    "insert_nodes": with_("nodes", "SELECT id, CASE WHEN is_delta THEN id // 2 ELSE parent_id END AS parent_id, metadata, round(v[1], 6) + 0.0 AS p0 FROM nodes"),
    "insert_delta": with_("nodes", "SELECT (-9223372036854775808 + (row_number() OVER (ORDER BY id) - 1))::BIGINT AS id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE round(v[1], 6) + 0.0 END AS p0 FROM nodes WHERE is_delta"),
    "sql_surface": with_(
        "nodes asked",
        "SELECT qid, round(list_cosine_similarity(qv, v), 6) + 0.0 AS cosine, round(list_max(list_transform(v, lambda x: abs(x))) / 127, 9) + 0.0 AS scale, flags & 1 <> 0 AS dead FROM asked JOIN nodes ON id = qid + 3",
    ),
}
