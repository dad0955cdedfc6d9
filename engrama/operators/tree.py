"""The vector tree: linkage, children, level-by-level navigation, the delta layer, consolidation and compaction.

Nodes are rows (id, parent_id, v, flags, hub_penalty, metadata); flag 1 marks a tombstone. Ids of the base grow with
insertion; delta nodes are rows of another DataFrame with ids of their own, negative by convention.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V
from engrama.session import stage

from .knn import knn

TOP_LIMIT = 50
MAX_BEAM = 16
#: Levels of a deep beam that are one union before they are written as one.
MAX_STEPS = 50
DEAD = 1
PENALTY = 1e9
METADATA_BYTES = 255
LOWEST = -(2**63)


def is_dead(flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(DEAD) != 0


def linked(nodes: DataFrame) -> DataFrame:
    """Adds linked: whether a node was inserted in one run with its earlier siblings, and so can be reached from above.

    The ids of siblings grow, so the k-th sibling is linked exactly if its id is the first one's plus k.
    """
    siblings = W.partitionBy("parent_id").orderBy("id")
    offset = F.col("id") - F.min("id").over(W.partitionBy("parent_id"))
    return nodes.withColumn("linked", F.col("parent_id").isNotNull() & (offset == F.row_number().over(siblings) - 1))


def children(nodes: DataFrame, parents: DataFrame, mode: str = "fixed") -> DataFrame:
    """(parent_id, id, preview) of the children of parents (parent_id); compat: linked ones only."""
    reachable = nodes if mode == "fixed" else linked(nodes).where("linked")
    return reachable.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").select("parent_id", "id", V.preview("v").alias("preview"))


def depths(nodes: DataFrame) -> DataFrame:
    """(id, depth) from the roots; nodes in no rooted chain are not returned. A join doubles the steps taken upwards."""
    step = F.when(F.col("parent_id").isNull(), 0).otherwise(1)
    now, taken = stage(nodes.select("id", F.col("parent_id").alias("up"), step.alias("depth")), "tree-depths"), 1
    most = now.count()
    while taken <= most and not (below := now.where("up is not null")).isEmpty():  # who has gone up further is on a cycle
        above = now.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        further = below.join(above, "up").select("id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        now, taken = stage(now.where("up is null").union(further), "tree-depths"), 2 * taken
    return now.where("up is null").select("id", "depth")


def beam_path(queries: DataFrame, nodes: DataFrame, width: int = 1, csls: bool = False, mode: str = "fixed") -> DataFrame:
    """(qid, level, id, score): from the root, the best node of each level that a beam of the width reaches.

    On each level the children of the beam's nodes are scored and the width best stay (score down, id up); width is held
    within 1 and 16. fixed: tombstones are never visited; compat: they are, and csls subtracts the hub penalty. One join
    on parent_id for each level, down to the last: keep nodes bucketed by parent_id to spare its shuffle. The beam is staged,
    as its size is that of the queries, times the width.
    """
    width = max(1, min(width, MAX_BEAM))
    live = nodes.where(~is_dead()) if mode == "fixed" else linked(nodes).where("linked or parent_id is null")
    score = V.cosine("qv", "v") - (F.col("hub_penalty") if csls and mode == "compat" else F.lit(0.0))
    q = queries.select("qid", V.doubles("qv").alias("qv"))
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    root = live.where(F.col("id") == 0).select("id", "v", "hub_penalty")
    beam = q.join(F.broadcast(root.limit(1))).select("qid", "qv", F.lit(0).alias("level"), "id", score.alias("score"), F.lit(1).alias("place"))
    # an id has one parent, so that nothing below the root comes twice
    steps, below = [], live.where("parent_id is not null and id <> 0").select("parent_id", "id", "v", "hub_penalty")
    for level in count(1):
        beam = stage(beam, "beam")
        if beam.isEmpty():
            break
        steps.append(beam.where("place = 1").select("qid", "level", "id", "score"))
        if len(steps) == MAX_STEPS:
            steps = [stage(reduce(DataFrame.union, steps), "beam-steps")]
        beam = below.join(beam.select("qid", "qv", F.col("id").alias("parent_id")), "parent_id").select("qid", "qv", F.lit(level).alias("level"), "id", score.alias("score"))
        beam = beam.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)
    return reduce(DataFrame.union, steps) if steps else beam.select("qid", "level", "id", "score")


def navigate(queries: DataFrame, nodes: DataFrame, delta: DataFrame | None = None, width: int = 1, limit: int = TOP_LIMIT, **options) -> DataFrame:
    """(qid, id, score, is_delta, rank): the beam's path and all delta nodes, sorted and cut at limit (1 to 50)."""
    out = beam_path(queries, nodes, width, **options).select("qid", "id", "score", F.lit(False).alias("is_delta"))
    if delta is not None:
        # no more than limit delta nodes can show
        fresh = knn(queries.select("qid", F.col("qv").alias("v")), delta.where(~is_dead()), max(1, min(limit, TOP_LIMIT))).select("qid", "id", "score", F.lit(True).alias("is_delta"))
        out = out.union(fresh)
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc("is_delta"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, min(limit, TOP_LIMIT)))


def prune_delta(delta: DataFrame, n: int) -> DataFrame:
    """delta without the n rows inserted last (by id)."""
    last = delta.select("id").orderBy(F.desc("id")).limit(n)
    return delta.join(last, "id", "left_anti")


def numbered(rows: DataFrame, order: str, name: str, first: int = 0) -> DataFrame:
    """rows with name: their number from first in the order of a column of distinct values, without one task that sees all.

    Rows are dealt by ranges, counted for each range, and numbered within; only the counts (one a range) meet.
    """
    dealt = stage(rows.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(before), "_part")
    return out.withColumn(name, (F.row_number().over(W.partitionBy("_part").orderBy(order)) + F.col("_before") - 1 + first).cast("long")).drop("_part", "_before")


def compact(nodes: DataFrame, delta: DataFrame | None = None, mode: str = "fixed") -> DataFrame:
    """(old_id, id, parent_id, was_delta and the other columns): live nodes renumbered without gaps, then delta nodes.

    A parent that died becomes null. fixed: promoted delta nodes hang under node 0; compat: they have no parent.
    """
    live = nodes.where(~is_dead())
    map_ = numbered(live.select(F.col("id").alias("old_id")), "old_id", "id")
    parents = map_.select(F.col("old_id").alias("parent_id"), F.col("id").alias("new_parent"))
    out = live.withColumnRenamed("id", "old_id").join(map_, "old_id").join(parents, "parent_id", "left").drop("parent_id").withColumnRenamed("new_parent", "parent_id").withColumn("was_delta", F.lit(False))
    if delta is not None:
        root = F.lit(0).cast("long") if mode == "fixed" else F.lit(None).cast("long")
        fresh = numbered(delta.where(~is_dead()).withColumnRenamed("id", "old_id"), "old_id", "id", map_.count())
        out = out.unionByName(fresh.drop("parent_id").withColumn("parent_id", root).withColumn("was_delta", F.lit(True)), allowMissingColumns=True)
    return out


def consolidate(nodes: DataFrame, ids: DataFrame, vector: list[float], metadata: str) -> DataFrame:
    """nodes after the nodes of ids (id) have been replaced by a summary node.

    The summary takes the next id and the parent of the first id given (the smallest); children of the old nodes that are
    not among them move under it; the old nodes become tombstones with a penalty. Raises ValueError if ids is empty, names
    an unknown node or one already dead.
    """
    old = ids.select("id").distinct()
    hit = nodes.join(old, "id", "left_semi")
    given = old.agg(F.count("*"), F.min("id")).first()
    there = hit.agg(F.count("*"), F.count_if(is_dead())).first()
    if not given[0]:
        raise ValueError("no ids")
    if there[0] < given[0]:
        raise ValueError("an id is unknown")
    if there[1]:
        raise ValueError("a node is already dead")
    top = nodes.agg(F.max("id")).first()[0] + 1
    parent = hit.where(F.col("id") == given[1]).select("parent_id").first()[0]
    marked = nodes.join(old.withColumn("_old", F.lit(True)), "id", "left")
    marked = marked.join(old.select(F.col("id").alias("parent_id"), F.lit(True).alias("_moves")), "parent_id", "left")
    moves = F.col("_moves").isNotNull() & F.col("_old").isNull()
    kept = marked.select(
        "id",
        F.when(moves, F.lit(top)).otherwise(F.col("parent_id")).cast("long").alias("parent_id"),
        "v",
        F.when(F.col("_old"), F.col("flags").bitwiseOR(DEAD)).otherwise(F.col("flags")).alias("flags"),
        F.when(F.col("_old"), F.lit(PENALTY)).otherwise(F.col("hub_penalty")).alias("hub_penalty"),
        "metadata",
    )
    row = [(top, parent, [float(x) for x in vector], 2, 0.0, metadata)]
    summary = nodes.sparkSession.createDataFrame(row, "id long, parent_id long, v array<double>, flags int, hub_penalty double, metadata string")
    return kept.unionByName(summary)


def insert(nodes: DataFrame, new: DataFrame, dim: int, order: str = "seq") -> DataFrame:
    """nodes and the rows of new (order, parent_id, v, metadata), which get the next ids in order.

    A vector of another size, or a parent that is not in nodes, raises as soon as its row is computed; metadata is cut to
    255 bytes. A null parent makes a root.
    """
    first = nodes.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    there = nodes.select(F.col("id").alias("_p"))
    rows = numbered(new, order, "id", first).join(there, F.col("parent_id") == F.col("_p"), "left")
    fault = F.when(F.coalesce(F.size("v"), F.lit(-1)) != dim, F.lit("dimension mismatch")).when(F.col("parent_id").isNotNull() & F.col("_p").isNull(), F.lit("unknown parent"))
    checked = F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(V.doubles("v"))
    rows = rows.select("id", "parent_id", checked.cast("array<double>").alias("v"), F.lit(0).alias("flags"), F.lit(0.0).alias("hub_penalty"), V.byte_prefix("metadata", METADATA_BYTES).alias("metadata"))
    return nodes.select(*rows.columns).unionByName(rows)


def insert_delta(delta: DataFrame, new: DataFrame, dim: int, order: str = "seq") -> DataFrame:
    """delta and the rows of new (order, v, metadata), with ids that have the highest bit set and count on.

    A vector of another size is stored as zeros.
    """
    first = delta.agg(F.coalesce(F.max("id") + 1, F.lit(LOWEST))).first()[0]
    zeros = F.array_repeat(F.lit(0.0), dim)
    fits = F.coalesce(F.size("v"), F.lit(-1)) == dim
    rows = numbered(new, order, "place").select((F.col("place") + F.lit(first)).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.when(fits, V.doubles("v")).otherwise(zeros).alias("v"), F.lit(0).alias("flags"), F.lit(0.0).alias("hub_penalty"), V.byte_prefix("metadata", METADATA_BYTES).alias("metadata"))
    return delta.select(*rows.columns).unionByName(rows)


def of_dimension(queries: DataFrame, dim: int) -> DataFrame:
    """Queries whose vector has the dimension: others have no answer."""
    return queries.where(F.size("qv") == dim)


def load_context(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(tick, node_id, v) of the base nodes named by ids (id, tick): inserts that warm a cache."""
    return nodes.join(ids.select("id", "tick"), "id").select("tick", F.col("id").alias("node_id"), "v")


def summarize_and_consolidate(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """nodes with those of ids (two at least) merged into a node of their mean vector and joined metadata."""
    from . import dream

    chosen = nodes.join(ids.select("id").distinct(), "id", "left_semi")
    if chosen.count() < 2:
        raise ValueError("at least two nodes are needed")
    text = dream.stub_summaries(chosen.select(F.lit(0).alias("g"), "id", F.col("metadata").alias("text")), "g", "id").first()
    return consolidate(nodes, ids, dream.mean_vector(chosen), text["summary"] if text else "")
