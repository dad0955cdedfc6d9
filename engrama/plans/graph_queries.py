"""The event graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import graph, tree

from . import fixtures as fx
from .fixtures import with_
from .trace_queries import embedded_events
from .tree_queries import beam_sql


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.edges(spark, sf_dir)


def backtrack_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backtrack(fx.events(spark, sf_dir), 2)


def ref_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = fx.nodes(spark, sf_dir).where("id % 20 = 0").select("id", "v")
    return graph.reference_edges(embedded_events(spark, sf_dir), concepts, 0.2)


def anchors_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.anchors(fx.edges(spark, sf_dir), fx.events(spark, sf_dir))


def causal_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(fx.edges(spark, sf_dir))


def spreading_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.edges(spark, sf_dir).where("relation <> 'REF'")
    seeds = fx.events(spark, sf_dir).where("turn = 0").select("id", F.lit(1.0).alias("activation"))
    return graph.spread(e, seeds, 2).select("id", F.round("activation", 6).alias("activation"))


def _own_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """REF edges to concepts of which each is shared by a few sessions."""
    e = fx.events(spark, sf_dir).where("role = 0")
    conv = F.floor((F.col("id") - 1) / fx.TURNS)
    return e.select(F.col("id").alias("src"), (conv % 37 * 100 + F.col("turn") % 5).cast("long").alias("dst"), F.lit("REF").alias("relation"))


def shared_anchor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shared_anchor_clusters(_own_concepts(spark, sf_dir)).select("id", "cluster")


def _bound(spark: SparkSession, sf_dir: str) -> int:
    return fx.events(spark, sf_dir).agg(F.floor(F.max("id") / 2)).first()[0]


def prune_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    committed = spark.range(10).where("id <> 3")
    return graph.prune_eligible(fx.events(spark, sf_dir), fx.edges(spark, sf_dir), committed, _bound(spark, sf_dir))


def chain_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.contract(fx.events(spark, sf_dir), prune_eligible(spark, sf_dir))


def typed_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    concepts = fx.nodes(spark, sf_dir).select((F.col("id") % 50).alias("id"), "metadata", F.col("id").alias("seq"))
    return graph.typed_vertices(fx.events(spark, sf_dir), concepts).groupBy("kind").agg(F.count("*").alias("n"), F.min("vertex").alias("first"), F.max("label").alias("last_label"))


def graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.as_json(fx.events(spark, sf_dir), fx.edges(spark, sf_dir))


def graph_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a round trip through JSON, linked again with all edges: none comes twice."""
    _, edges = graph.from_json(graph_json(spark, sf_dir))
    return graph.link(edges, fx.edges(spark, sf_dir))


def link_top_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn in twenty is navigated through the tree and linked to the three best concepts."""
    q = embedded_events(spark, sf_dir).where("id % 20 = 1").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    found = tree.navigate(q, fx.nodes(spark, sf_dir), None, 3)
    return graph.link_concepts(found, fx.events(spark, sf_dir)).select("src", "dst", "relation")


def active_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = fx.events(spark, sf_dir).select("session_id", F.col("id").alias("seq"), "concept_id")
    return graph.active_room(links, fx.nodes(spark, sf_dir))


_PRUNED = """bound AS (SELECT max(id) // 2 AS b FROM log),
pruned AS (SELECT id FROM log, bound WHERE id < b AND id NOT IN (SELECT src FROM edges JOIN log w ON w.id = dst WHERE relation = 'CAUSAL' AND w.flags = 0)
  AND id NOT IN (SELECT src FROM edges WHERE relation = 'REF' AND NOT (dst BETWEEN 0 AND 9 AND dst <> 3)))"""

QUERIES = {f.__name__: f for f in (graph_edges, backtrack_k, ref_edges, anchors_inverse, causal_ancestors, spreading_activation, shared_anchor_clusters, prune_eligible, chain_contract, typed_vertices, graph_json, graph_reloaded, link_top_concepts, active_room)}
SQL = {
    "graph_edges": with_("edges", "SELECT src, dst, relation FROM edges"),
    "backtrack_k": with_("log", "b AS (SELECT id, lag(id, 2) OVER (PARTITION BY session_id ORDER BY id) AS back_id FROM log) SELECT * FROM b WHERE back_id IS NOT NULL"),
    "ref_edges": with_("log nodes", "e AS (SELECT log.id, v FROM log JOIN nodes ON nodes.id = log.id % (SELECT count(*) FROM nodes) WHERE role = 0) SELECT e.id AS src, n.id AS dst, 'REF' AS relation FROM e, nodes n WHERE n.id % 20 = 0 AND list_cosine_similarity(e.v, n.v) > 0.2"),
    "anchors_inverse": with_("edges", "SELECT dst AS concept, count(DISTINCT src) AS episodes, min(src) AS first_id, max(src) AS last_id FROM edges WHERE relation = 'REF' GROUP BY dst"),
    "causal_ancestors": "WITH RECURSIVE " + ",\n".join(fx.SQL[k] for k in ("log", "edges")) + ", a AS (SELECT dst AS id, src AS ancestor, 1 AS distance FROM edges WHERE relation = 'CAUSAL' UNION ALL SELECT a.id, e.src, a.distance + 1 FROM a JOIN edges e ON e.dst = a.ancestor AND e.relation = 'CAUSAL') SELECT id, ancestor, min(distance) AS distance FROM a GROUP BY id, ancestor",
    "spreading_activation": with_(
        "edges",
        """mixed_ AS (SELECT src, dst FROM edges WHERE relation <> 'REF' UNION SELECT dst, src FROM edges WHERE relation <> 'REF'),
s0 AS (SELECT id, 1.0::DOUBLE AS a FROM log WHERE turn = 0), s1 AS (SELECT dst AS id, sum(a * 0.5) AS a FROM s0 JOIN mixed_ ON src = id GROUP BY dst),
s2 AS (SELECT dst AS id, sum(a * 0.5) AS a FROM s1 JOIN mixed_ ON src = id GROUP BY dst)
SELECT id, round(sum(a), 6) + 0.0 AS activation FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id""",
    ),
    "shared_anchor_clusters": with_("log", f"r AS (SELECT id, (id - 1) // {fx.TURNS} % 37 * 100 + turn % 5 AS dst FROM log WHERE role = 0) SELECT id, min(id) OVER (PARTITION BY dst) AS cluster FROM r"),
    "prune_eligible": with_("edges", f"{_PRUNED} SELECT id FROM pruned"),
    "chain_contract": with_("edges", f"{_PRUNED}, n AS (SELECT id, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS prev FROM log WHERE id NOT IN (SELECT id FROM pruned)) SELECT prev AS src, id AS dst, 'NEXT' AS relation FROM n WHERE prev IS NOT NULL"),
    "typed_vertices": with_(
        "log nodes",
        """v AS (SELECT CASE WHEN role = 0 THEN 'u_' ELSE 's_' END || id AS vertex, CASE WHEN role = 0 THEN 'User' ELSE 'System' END AS kind, text AS label FROM log
UNION ALL SELECT 'c_' || (id % 50), 'Concept', arg_min(metadata, id) FROM nodes GROUP BY id % 50)
SELECT kind, count(*) AS n, min(vertex) AS first, max(label) AS last_label FROM v GROUP BY kind""",
    ),
    "graph_json": with_(
        "edges",
        """n AS (SELECT session_id, list(id ORDER BY id) AS nodes FROM log GROUP BY session_id),
e AS (SELECT session_id, list({'src': src, 'dst': dst} ORDER BY src, dst) AS edges FROM edges JOIN log ON log.id = dst WHERE relation = 'NEXT' GROUP BY session_id)
SELECT session_id, to_json({'nodes': nodes, 'edges': coalesce(edges, [])})::VARCHAR AS graph FROM n LEFT JOIN e USING (session_id)""",
    ),
    "graph_reloaded": with_("edges", "SELECT DISTINCT src, dst, relation FROM edges"),
    "link_top_concepts": beam_sql(
        3,
        fixtures="log nodes",
        first="asked AS (SELECT log.id AS qid, v AS qv FROM log JOIN nodes ON nodes.id = log.id % (SELECT count(*) FROM nodes) WHERE role = 0 AND log.id % 20 = 1)",
        select="SELECT qid AS src, id AS dst, 'CAUSAL' AS relation FROM path QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 3",
    ),
    "active_room": with_("log nodes", "l AS (SELECT session_id, arg_max(concept_id, id) AS room FROM log GROUP BY session_id) SELECT session_id, room, n.id FROM l JOIN nodes n ON n.parent_id = room"),
}
