"""The store's tables, derived from the given tables in Spark, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions import vectors as V
from engrama.operators import trace

FANOUT = 8
#: One row in so many, the last ones, is still in the delta.
DELTA_SHARE = 10
TURNS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of fan-out 8 over all embeddings; each tenth node is dead, layers and metadata come from the label."""
    e = table(spark, sf_dir, "embeddings")
    dead = F.col("vec_id") % 10 == 7
    return e.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("vec_id") > 0, F.floor((F.col("vec_id") - 1) / FANOUT)).cast("long").alias("parent_id"),
        V.doubles("embedding").alias("v"),
        F.when(dead, 1).otherwise(0).alias("flags"),
        F.when(dead, 1e9).otherwise(0.0).alias("hub_penalty"),
        F.concat(F.lit("layer_"), (F.col("label") % 5).cast("string")).alias("layer_id"),
        F.concat(F.lit("label="), F.col("label").cast("string")).alias("metadata"),
    )


def gap_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with each eleventh node under the root, which breaks the runs of its siblings."""
    parent = F.when(F.col("id") == 0, F.lit(None)).when(F.col("id") % 11 == 0, F.lit(0)).otherwise(F.col("parent_id")).cast("long")
    return nodes(spark, sf_dir).withColumn("parent_id", parent)


def split_delta(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base and delta: the last tenth of the ids is still in the delta."""
    n = nodes(spark, sf_dir)
    rows = n.count()
    first = rows - rows // DELTA_SHARE
    return n.where(F.col("id") < first), n.where(F.col("id") >= first)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, v, qv): queries for each id divisible by 20, between its vector and the next one's."""
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("qid"), F.col("embedding").alias("b"))
    step = 0.3 * (F.floor(F.col("qid") / 20) % 4)
    q = F.zip_with("a", "b", lambda x, y: x.cast("double") + F.col("step") * y.cast("double"))
    out = a.join(b, "qid").withColumn("step", step).select("qid", q.alias("v"))
    return out.withColumn("qv", F.col("v"))


def events(spark: SparkSession, sf_dir: str, dead_every: int = 7) -> DataFrame:
    """The conversations as a log: (id, session_id, turn, role, text, concept_id, flags)."""
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    id_ = F.col("conv_id") * TURNS + F.col("turn") + 1
    flag = F.when((F.col("conv_id") * 3 + F.col("turn")) % dead_every == 0, 1).otherwise(0)
    return c.select(id_.alias("id"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"), "turn", trace.role_code("role", "other").alias("role"), "text", (id_ % 10).alias("concept_id"), flag.alias("flags"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT between turns, CAUSAL from each turn to that three later, REF from user turns to concepts 0 to 9."""
    e = events(spark, sf_dir)
    nxt = trace.chained(e).where("prev_id is not null").select(F.col("prev_id").alias("src"), F.col("id").alias("dst"), F.lit("NEXT").alias("relation"))
    later = e.select("session_id", (F.col("turn") - 3).alias("turn"), F.col("id").alias("dst"))
    causal = e.select("session_id", "turn", F.col("id").alias("src")).join(later, ["session_id", "turn"]).select("src", "dst", F.lit("CAUSAL").alias("relation"))
    ref = e.where("role = 0").select(F.col("id").alias("src"), (F.col("id") % 10).alias("dst"), F.lit("REF").alias("relation"))
    return nxt.union(causal).union(ref)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, qv, best_similarity): two sessions of queries over all embeddings."""
    e = table(spark, sf_dir, "embeddings")
    best = F.lit(1.0) / F.sqrt(1.0 + F.pow(0.3 * (F.col("vec_id") % 5), F.lit(2)))
    return e.select(F.concat(F.lit("s"), (F.col("vec_id") % 2).cast("string")).alias("session_id"), F.floor(F.col("vec_id") / 2).cast("long").alias("seq"), V.doubles("embedding").alias("qv"), best.alias("best_similarity"))


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, payload, checksum): the props of all events; each 601st modulo 5000 has a checksum that is wrong."""
    e = table(spark, sf_dir, "events")
    sum_ = F.when(F.col("event_id") % 5000 == 600, F.lit("bad")).otherwise(F.md5("props"))
    return e.select((F.col("event_id") + 1).alias("seq"), F.col("props").alias("payload"), sum_.alias("checksum"))


SQL = {
    "nodes": f"""nodes AS (
  SELECT vec_id AS id, CASE WHEN vec_id > 0 THEN (vec_id - 1) // {FANOUT} END AS parent_id, embedding::DOUBLE[] AS v,
         CASE WHEN vec_id % 10 = 7 THEN 1 ELSE 0 END AS flags, CASE WHEN vec_id % 10 = 7 THEN 1e9 ELSE 0.0 END AS hub_penalty,
         'layer_' || (label % 5) AS layer_id, 'label=' || label AS metadata,
         vec_id >= (SELECT count(*) - count(*) // {DELTA_SHARE} FROM embeddings) AS is_delta FROM embeddings)""",
    "gap_nodes": "gap_nodes AS (SELECT * REPLACE (CASE WHEN id = 0 THEN NULL WHEN id % 11 = 0 THEN 0 ELSE parent_id END AS parent_id) FROM nodes)",
    "asked": """asked AS (
  SELECT a.vec_id AS qid, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: z[1] + 0.3 * (a.vec_id // 20 % 4) * z[2]) AS qv
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0)""",
    "log": f"""log AS (
  SELECT conv_id * {TURNS} + turn + 1 AS id, 'conv-' || conv_id AS session_id, turn,
         CASE lower(role) WHEN 'user' THEN 0 WHEN 'system' THEN 1 WHEN 'concept' THEN 2 WHEN 'summary' THEN 3
              WHEN 'assistant' THEN 10 WHEN 'tool' THEN 11 ELSE 12 END AS role, text,
         (conv_id * {TURNS} + turn + 1) % 10 AS concept_id, CASE WHEN (conv_id * 3 + turn) % 7 = 0 THEN 1 ELSE 0 END AS flags
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL)""",
    "edges": """edges AS (
  SELECT prev AS src, id AS dst, 'NEXT' AS relation FROM (SELECT id, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS prev FROM log) WHERE prev IS NOT NULL
  UNION ALL SELECT a.id, b.id, 'CAUSAL' FROM log a JOIN log b ON a.session_id = b.session_id AND b.turn = a.turn + 3
  UNION ALL SELECT id, id % 10, 'REF' FROM log WHERE role = 0)""",
    "telemetry": """telemetry AS (
  SELECT 's' || (vec_id % 2) AS session_id, vec_id // 2 AS seq, embedding::DOUBLE[] AS qv, 1.0::DOUBLE / sqrt(1.0 + pow(0.3 * (vec_id % 5), 2)) AS best_similarity
  FROM embeddings)""",
    "records": "records AS (SELECT event_id + 1 AS seq, props AS payload, CASE WHEN event_id % 5000 = 600 THEN 'bad' ELSE md5(props) END AS checksum FROM events)",
}
NEEDS = {"gap_nodes": ["nodes"], "edges": ["log"]}


def with_(names: str, body: str) -> str:
    """SQL with the fixtures named (spaces between) in front of body, which is more CTEs and a SELECT."""
    order: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    return "WITH " + ",\n".join(SQL[n] for n in order) + (",\n" if not body.lstrip().upper().startswith("SELECT") else "\n") + body
