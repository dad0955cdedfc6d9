"""Transcripts as JSON lines, and sessions as JSON: what agents outside the engine read and write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.operators import trace

LINE = "session_id string, role string, content string, ts timestamp"
USER_ID = r"^[a-zA-Z0-9_-]+$"


def save_turns(events: DataFrame, path: str) -> None:
    """Append events as lines {session_id, role, content, ts}."""
    lines = events.select("session_id", trace.role_name("role").alias("role"), F.col("text").alias("content"), "ts")
    lines.write.mode("append").json(path)


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Lines as rows with role codes; lines that aren't JSON are left out."""
    rows = spark.read.schema(LINE).option("mode", "DROPMALFORMED").json(path)
    return rows.select("session_id", trace.role_code("role", "other").alias("role"), F.col("content").alias("text"), "ts")


def latest(turns: DataFrame, limit: int) -> DataFrame:
    """The last turns of each session in time, oldest first by place."""
    newest = W.partitionBy("session_id").orderBy(F.desc("ts"))
    return turns.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit)


def valid_users(users: DataFrame, col: str = "user_id") -> DataFrame:
    """Rows whose user id is letters, digits, _ and - only, so that it can name a file."""
    return users.where(F.col(col).rlike(USER_ID))


def save_sessions(sessions: DataFrame, path: str) -> None:
    """One JSON object a session, in folders by session; Spark's commit makes the replacement whole."""
    sessions.write.mode("overwrite").json(path)


def load_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sessions as save_sessions wrote them; their schema is the caller's."""
    return spark.read.schema(schema).json(path)
