"""Queries over the event graph: edges (src, dst, relation) of kinds NEXT, CAUSAL and REF."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.session import stage

from .components import components
from .knn import similar_above
from .tree import is_dead


def next_edges(events: DataFrame) -> DataFrame:
    return events.where("prev_id is not null").select(F.col("prev_id").alias("src"), F.col("id").alias("dst"), F.lit("NEXT").alias("relation"))


def backtrack(events: DataFrame, hops: int) -> DataFrame:
    """(id, back_id): the event so many hops earlier in the session, where there is one."""
    return events.select("id", F.lag("id", hops).over(W.partitionBy("session_id").orderBy("id")).alias("back_id")).where("back_id is not null")


def reference_edges(events: DataFrame, concepts: DataFrame, threshold: float) -> DataFrame:
    """REF edges from events (id, v) to every concept (id, v) more similar than the threshold, in blocks of concepts."""
    found = similar_above(concepts.select(F.col("id").alias("qid"), "v"), events.select("id", "v"), threshold)
    return found.select(F.col("id").alias("src"), F.col("qid").alias("dst"), F.lit("REF").alias("relation"))


def anchors(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(concept, episodes, first_id, last_id): the episodes grounded to each concept."""
    refs = edges.where("relation = 'REF'").join(events.select(F.col("id").alias("src")), "src", "left_semi")
    return refs.groupBy(F.col("dst").alias("concept")).agg(F.countDistinct("src").alias("episodes"), F.min("src").alias("first_id"), F.max("src").alias("last_id"))


def ancestors(edges: DataFrame, relation: str = "CAUSAL") -> DataFrame:
    """(id, ancestor, distance): all along edges of one kind, the shortest distance; a join doubles the distance covered.

    A shortest path of over m and up to 2m steps is one of m steps and one of up to m, so only pairs m steps apart are joined.
    """
    steps = edges.where(F.col("relation") == relation).select(F.col("dst").alias("id"), F.col("src").alias("ancestor")).distinct()
    found, most = stage(steps.withColumn("distance", F.lit(1)), "ancestors"), 1
    while not (far := found.where(F.col("distance") == most)).isEmpty():
        on = found.select(F.col("id").alias("via"), F.col("ancestor"), F.col("distance").alias("more"))
        reached = far.select("id", F.col("ancestor").alias("via")).join(on, "via").groupBy("id", "ancestor").agg((F.min("more") + most).alias("distance"))
        found = found.union(stage(reached.join(found, ["id", "ancestor"], "left_anti"), "ancestors"))
        most *= 2
    return found


def spread(edges: DataFrame, seeds: DataFrame, hops: int, decay: float = 0.5) -> DataFrame:
    """(id, activation) after so many hops from seeds (id, activation) along any edge, either way, each hop times decay."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    now, total = seeds.select("id", "activation"), seeds.select("id", "activation")
    for _ in range(hops):
        now = now.join(both, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("activation") * decay).alias("activation"))
        total = total.union(now)
    return total.groupBy("id").agg(F.sum("activation").alias("activation"))


def shared_anchor_clusters(edges: DataFrame) -> DataFrame:
    """(id, cluster): events that share a concept, directly or over others; the cluster is its smallest event.

    Each event is joined with the first of its concept, so that a concept of n events costs n rows, not n * n.
    """
    refs = stage(edges.where("relation = 'REF'").select("src", "dst").distinct(), "anchor-refs")
    first = refs.groupBy("dst").agg(F.min("src").alias("b"))
    found = components(refs.join(first, "dst").select(F.col("src").alias("a"), "b"), "anchor-clusters")
    return refs.select(F.col("src").alias("id")).distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def prune_eligible(events: DataFrame, edges: DataFrame, committed: DataFrame, before: int) -> DataFrame:
    """(id) of events older than `before` (by id), with all their REFs committed (concept ids) and without a CAUSAL edge to
    an active event: one that is in events and not a tombstone."""
    refs = edges.where("relation = 'REF'").select(F.col("src").alias("id"), F.col("dst").alias("concept"))
    open_refs = refs.join(committed.select(F.col("id").alias("concept")), "concept", "left_anti").select("id")
    active = events.where(~is_dead()).select(F.col("id").alias("dst"))
    causes = edges.where("relation = 'CAUSAL'").join(active, "dst", "left_semi").select(F.col("src").alias("id"))
    return events.where(F.col("id") < before).select("id").join(open_refs.union(causes).distinct(), "id", "left_anti")


def contract(events: DataFrame, pruned: DataFrame) -> DataFrame:
    """NEXT edges after pruned events (id) went: each survivor follows the survivor before it."""
    left = events.join(pruned.select("id"), "id", "left_anti")
    return next_edges(left.select("id", "session_id", F.lag("id").over(W.partitionBy("session_id").orderBy("id")).alias("prev_id")))


def typed_vertices(events: DataFrame, concepts: DataFrame) -> DataFrame:
    """(vertex, kind, label): prefixed ids u_, s_ and c_; of a concept added twice the first stays."""
    kind = F.when(F.col("role") == 0, "User").otherwise("System")
    spoken = events.select(F.concat(F.when(F.col("role") == 0, "u_").otherwise("s_"), F.col("id").cast("string")).alias("vertex"), kind.alias("kind"), F.col("text").alias("label"))
    named = concepts.groupBy("id").agg(F.min_by("metadata", "seq").alias("label"))
    return spoken.union(named.select(F.concat(F.lit("c_"), F.col("id").cast("string")).alias("vertex"), F.lit("Concept").alias("kind"), "label"))


def as_json(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, graph): for each session its events and the NEXT edges between them, as one JSON object."""
    nodes = events.groupBy("session_id").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    own = edges.where("relation = 'NEXT'").join(events.select(F.col("id").alias("dst"), "session_id"), "dst")
    links = own.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    out = nodes.join(links, "session_id", "left")
    return out.select("session_id", F.to_json(F.struct("nodes", F.coalesce("edges", F.array().cast("array<struct<src:bigint,dst:bigint>>")).alias("edges"))).alias("graph"))


def from_json(graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events (id, session_id) and NEXT edges (src, dst, relation) of graphs (session_id, graph) that as_json has made."""
    parsed = graphs.select("session_id", F.from_json("graph", "nodes array<long>, edges array<struct<src: long, dst: long>>").alias("g"))
    edges = parsed.select(F.explode("g.edges").alias("e")).select("e.src", "e.dst", F.lit("NEXT").alias("relation"))
    return parsed.select(F.explode("g.nodes").alias("id"), "session_id"), edges


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with those of new; an edge that is there already is not added again."""
    columns = ["src", "dst", "relation"]
    return edges.unionByName(new.select(*columns).distinct().join(edges.select(*columns).distinct(), columns, "left_anti"), allowMissingColumns=True)


def link_concepts(navigated: DataFrame, events: DataFrame, top: int = 3) -> DataFrame:
    """CAUSAL edges from each event to the best concepts that navigation found for it (qid is the event's id)."""
    ranked = navigated.join(events.select(F.col("id").alias("qid")), "qid", "left_semi")
    ranked = ranked.withColumn("k", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).where(F.col("k") <= top)
    return ranked.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.lit("CAUSAL").alias("relation"))


def active_room(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, room, id): the children of the concept that each session (session_id, seq, concept_id) linked last."""
    last = links.where("concept_id is not null").groupBy("session_id").agg(F.max_by("concept_id", "seq").alias("room"))
    return last.join(nodes.select(F.col("parent_id").alias("room"), "id"), "room").select("session_id", "room", "id")
