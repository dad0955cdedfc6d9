"""The tree: linkage, navigation, delta, consolidation and compaction; blocks and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import blocks, cache, dream, tree

from . import fixtures as fx
from .fixtures import with_
from .vector_queries import r6

BLOCK = 64


def tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir)
    return n.join(n.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children")), "id", "left").select("id", "parent_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def linked_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.linked(fx.gap_nodes(spark, sf_dir)).select("id", "parent_id", "linked")


def get_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.gap_nodes(spark, sf_dir)
    c = tree.children(n, n.where("id % 20 = 0").select(F.col("id").alias("parent_id")), mode="compat")
    return c.select("parent_id", "id", *[r6(F.element_at("preview", k + 1)).alias(f"p{k}") for k in range(3)])


def tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.depths(fx.gap_nodes(spark, sf_dir)).select("id", "depth")


def _beam(width: int, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tree.beam_path(fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir), width, **options).select("qid", "level", "id", r6("score").alias("score"))

    return query


def beam_compat_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.beam_path(fx.asked(spark, sf_dir), fx.gap_nodes(spark, sf_dir), 2, mode="compat").select("qid", "level", "id", r6("score").alias("score"))


def navigate_merge_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = fx.split_delta(spark, sf_dir)
    return tree.navigate(fx.asked(spark, sf_dir), base, delta, 3, limit=10).select("qid", "id", r6("score").alias("score"), "is_delta", "rank")


def tombstone_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir)
    return n.groupBy("layer_id").agg(F.count("*").alias("total"), F.count_if(tree.is_dead()).alias("dead"))


def delta_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = fx.split_delta(spark, sf_dir)
    return base.select("id", F.lit(False).alias("is_delta")).union(tree.prune_delta(delta, 5).select("id", F.lit(True).alias("is_delta")))


def delta_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta rows get ids with the highest bit set: negative as signed numbers, counting up from the lowest."""
    base, delta = fx.split_delta(spark, sf_dir)
    fresh = tree.numbered(delta.select(F.col("id").alias("was")), "was", "place").select((F.col("place") + F.lit(-(2**63))).alias("id"), "was")
    return base.select("id", F.col("id").alias("was")).union(fresh)


def compact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = fx.split_delta(spark, sf_dir)
    return tree.compact(base, delta).select("old_id", "id", "was_delta")


def compact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = fx.split_delta(spark, sf_dir)
    return tree.compact(base, delta).select("id", "parent_id", "was_delta")


def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir)
    out = tree.consolidate(n, n.where("id between 1 and 30 and flags = 0").select("id"), [0.0] * 64, "summary")
    return out.select("id", "parent_id", "flags", "hub_penalty")


def dream_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dream.dream(fx.nodes(spark, sf_dir), batch=30)[1]


def dream_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dream.pressure(fx.nodes(spark, sf_dir), 128.0, 64).select("total", "dead", r6("dead_share").alias("dead_share"), r6("size_mb").alias("size_mb"), "should_dream")


def stub_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dream.stub_summaries(fx.events(spark, sf_dir), "session_id", "id")


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.nodes(spark, sf_dir).select(F.col("id").alias("seq"), "id", (F.col("id") * 0.5).alias("ts"), "v")


def block_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = blocks.centroids(_timeline(spark, sf_dir), BLOCK)
    return c.select("block_id", "n", "first_ts", "last_ts", "sealed", F.posexplode("v").alias("pos", "m")).select("block_id", "n", "first_ts", "last_ts", "sealed", F.col("pos").cast("long").alias("pos"), r6("m").alias("m"))


def block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.search(fx.asked(spark, sf_dir), _timeline(spark, sf_dir), 5, 3, BLOCK).select("qid", "id", r6("score").alias("score"), "rank")


def _inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of inserts: each node at its tick, and the even ones of the last stretch once more."""
    n = fx.nodes(spark, sf_dir).select(F.col("id").alias("tick"), F.col("id").alias("node_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session_id"), "v")
    again = n.where("node_id % 2 = 0").select((F.col("tick") + 100_000_001 + (F.col("tick") * 7919) % 1000 * 1_000_000).alias("tick"), "node_id", "session_id", "v")
    return n.union(again)


def cache_lru_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.snapshot(_inserts(spark, sf_dir)).select("node_id", "tick")


def cache_l1_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.asked(spark, sf_dir).select("qid", F.concat(F.lit("s"), (F.col("qid") % 3).cast("string")).alias("session_id"), "v")
    return cache.two_level_lookup(q, _inserts(spark, sf_dir)).select("qid", F.col("level").cast("long").alias("level"), "id", r6("score").alias("score"))


def cache_sessions_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = fx.events(spark, sf_dir).select("session_id", F.col("id").alias("tick"))
    return cache.live_sessions(touches, 20)


def cached_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Navigation with both caches in front: only queries that miss them go through the tree."""
    q = fx.asked(spark, sf_dir).select("qid", F.concat(F.lit("s"), (F.col("qid") % 3).cast("string")).alias("session_id"), "v", "qv")
    out = cache.navigate_cached(q, _inserts(spark, sf_dir), lambda missed: tree.navigate(missed, fx.nodes(spark, sf_dir), None, 3))
    return out.select("qid", F.col("level").cast("long").alias("level"), "id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


def cache_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.occupied(_inserts(spark, sf_dir), by="session_id")


def beam_sql(width: int, nodes: str = "SELECT * FROM nodes WHERE flags = 0", score: str = "list_cosine_similarity(b.qv, n.v)", levels: int = 8, fixtures: str = "nodes asked", select: str = "", first: str = "") -> str:
    body = [*([first] if first else []), f"live AS ({nodes})", f"l0 AS (SELECT b.qid, b.qv, 0 AS level, n.id, {score} AS s, 1 AS place FROM asked b, live n WHERE n.id = 0)"]
    for k in range(1, levels + 1):
        body.append(f"l{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS place FROM (SELECT b.qid, b.qv, {k} AS level, n.id, {score} AS s FROM l{k - 1} b JOIN live n ON n.parent_id = b.id)) WHERE place <= {width})")
    path = " UNION ALL ".join(f"SELECT qid, level, id, s FROM l{k} WHERE place = 1" for k in range(levels + 1))
    return with_(fixtures, ",\n".join(body) + f", path AS ({path}) " + (select or "SELECT qid, level, id, round(s, 6) + 0.0 AS score FROM path"))


_LINKED = "linked AS (SELECT *, parent_id IS NOT NULL AND id - min(id) OVER (PARTITION BY parent_id) = row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS linked FROM gap_nodes)"
_DEPTH = "WITH RECURSIVE " + ",\n".join(fx.SQL[k] for k in ("nodes", "gap_nodes")) + ", d AS (SELECT id, 0 AS depth FROM gap_nodes WHERE parent_id IS NULL UNION ALL SELECT g.id, d.depth + 1 FROM gap_nodes g JOIN d ON g.parent_id = d.id) SELECT id, depth FROM d"
_COMPACT = """base AS (SELECT * FROM nodes WHERE NOT is_delta AND flags = 0), map AS (SELECT id AS old_id, row_number() OVER (ORDER BY id) - 1 AS id FROM base),
fresh AS (SELECT id AS old_id, (SELECT count(*) FROM map) + row_number() OVER (ORDER BY id) - 1 AS id FROM nodes WHERE is_delta AND flags = 0)"""
_INSERTS = """inserts AS (SELECT id AS tick, id AS node_id, 's' || (id % 3) AS session_id, v FROM nodes
UNION ALL SELECT id + 100000001 + (id * 7919) % 1000 * 1000000, id, 's' || (id % 3), v FROM nodes WHERE id % 2 = 0)"""
_LOOKUP = """one AS (SELECT session_id, node_id, max(tick) AS tick, arg_max(v, tick) AS v FROM inserts GROUP BY session_id, node_id QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY max(tick) DESC, node_id) <= 64),
two AS (SELECT node_id, max(tick) AS tick, arg_max(v, tick) AS v FROM inserts GROUP BY node_id ORDER BY tick DESC, node_id LIMIT 256),
a AS (SELECT qid, node_id AS id, list_cosine_similarity(qv, v) AS s FROM asked JOIN one ON session_id = 's' || (qid % 3) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) = 1),
b AS (SELECT qid, node_id AS id, list_cosine_similarity(qv, v) AS s FROM asked, two QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) = 1),
looked AS (SELECT q.qid, CASE WHEN a.s >= 0.85 THEN 1 WHEN b.s >= 0.85 THEN 2 ELSE 0 END::BIGINT AS level,
CASE WHEN a.s >= 0.85 THEN a.id WHEN b.s >= 0.85 THEN b.id END AS id, CASE WHEN a.s >= 0.85 THEN a.s WHEN b.s >= 0.85 THEN b.s END AS s
FROM asked q LEFT JOIN a USING (qid) LEFT JOIN b USING (qid))"""
_BLOCKS = f"""blocked AS (SELECT id // {BLOCK} AS block_id, id, id * 0.5::DOUBLE AS ts, v FROM nodes),
parts AS (SELECT block_id, generate_subscripts(v, 1) - 1 AS pos, unnest(v) AS x FROM blocked), means AS (SELECT block_id, pos, avg(x) AS m FROM parts GROUP BY ALL),
facts AS (SELECT block_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(*) = {BLOCK} AS sealed FROM blocked GROUP BY block_id)"""

QUERIES = {
    "beam1": _beam(1),
    "beam3": _beam(3),
    "csls_penalty": _beam(3, mode="compat", csls=True),
    **{f.__name__: f for f in (tree_parents, linked_children, get_children, tree_depth, beam_compat_gaps, navigate_merge_delta, tombstone_count, delta_prune, delta_ids, compact_ids, compact_links, consolidate, dream_cycle, dream_pressure, stub_summary, block_centroids, block_search, cache_lru_snapshot, cache_l1_l2, cache_sessions_lru, cached_navigation, cache_slots)},
}
SQL = {
    "tree_parents": with_("nodes", "SELECT n.id, n.parent_id, count(c.id) AS n_children FROM nodes n LEFT JOIN nodes c ON c.parent_id = n.id GROUP BY n.id, n.parent_id"),
    "linked_children": with_("gap_nodes", f"{_LINKED} SELECT id, parent_id, linked FROM linked"),
    "get_children": with_("gap_nodes", f"{_LINKED} SELECT parent_id, id, round(v[1], 6) + 0.0 AS p0, round(v[2], 6) + 0.0 AS p1, round(v[3], 6) + 0.0 AS p2 FROM linked WHERE linked AND parent_id % 20 = 0"),
    "tree_depth": _DEPTH,
    "beam1": beam_sql(1),
    "beam3": beam_sql(3),
    "csls_penalty": beam_sql(3, "SELECT * FROM nodes", "list_cosine_similarity(b.qv, n.v) - n.hub_penalty"),
    "beam_compat_gaps": beam_sql(2, "SELECT * FROM (SELECT *, parent_id IS NOT NULL AND id - min(id) OVER (PARTITION BY parent_id) = row_number() OVER (PARTITION BY parent_id ORDER BY id) - 1 AS linked FROM gap_nodes) WHERE linked OR parent_id IS NULL", levels=30, fixtures="gap_nodes asked"),
    "navigate_merge_delta": beam_sql(
        3,
        "SELECT * FROM nodes WHERE flags = 0 AND NOT is_delta",
        select="""SELECT qid, id, round(s, 6) + 0.0 AS score, is_delta, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, is_delta, id)::INT AS rank FROM (
SELECT qid, id, s, false AS is_delta FROM path UNION ALL SELECT qid, id, list_cosine_similarity(qv, v), true FROM asked, nodes WHERE is_delta AND flags = 0)) WHERE rank <= 10""",
    ),
    "tombstone_count": with_("nodes", "SELECT layer_id, count(*) AS total, count_if(flags & 1 <> 0)::BIGINT AS dead FROM nodes GROUP BY layer_id"),
    "delta_prune": with_("nodes", "SELECT id, is_delta FROM nodes WHERE id < (SELECT count(*) FROM nodes) - 5"),
    "delta_ids": with_("nodes", "SELECT id, id AS was FROM nodes WHERE NOT is_delta UNION ALL SELECT (-9223372036854775808 + (row_number() OVER (ORDER BY id) - 1))::BIGINT, id FROM nodes WHERE is_delta"),
    "compact_ids": with_("nodes", f"{_COMPACT} SELECT old_id, id, false AS was_delta FROM map UNION ALL SELECT old_id, id, true FROM fresh"),
    "compact_links": with_("nodes", f"{_COMPACT} SELECT m.id, p.id AS parent_id, false AS was_delta FROM map m JOIN base b ON b.id = m.old_id LEFT JOIN map p ON p.old_id = b.parent_id UNION ALL SELECT id, 0, true FROM fresh"),
    "consolidate": with_(
        "nodes",
        """SELECT id, CASE WHEN parent_id BETWEEN 1 AND 30 AND parent_id % 10 <> 7 AND NOT (id BETWEEN 1 AND 30 AND flags = 0) THEN (SELECT max(id) + 1 FROM nodes) ELSE parent_id END AS parent_id,
CASE WHEN id BETWEEN 1 AND 30 THEN 1 ELSE flags END AS flags, CASE WHEN id BETWEEN 1 AND 30 THEN 1e9 ELSE hub_penalty END AS hub_penalty FROM nodes
UNION ALL SELECT max(id) + 1, 0, 2, 0.0 FROM nodes""",
    ),
    "dream_cycle": with_("nodes", "SELECT count(*) AS nodes_before, count_if(flags = 1)::BIGINT AS dead_before, count_if(flags = 0 AND id BETWEEN 1 AND 30)::BIGINT AS consolidated, (count_if(flags = 0 AND NOT id BETWEEN 1 AND 30) + 1)::BIGINT AS nodes_after, true AS ran FROM nodes"),
    "dream_pressure": with_("nodes", "SELECT count(*) AS total, count_if(flags = 1)::BIGINT AS dead, round(count_if(flags = 1) / count(*), 6) + 0.0 AS dead_share, round(count(*) * 576 / (1024.0 * 1024.0), 6)::DOUBLE AS size_mb, count_if(flags = 1) / count(*) > 0.25 OR count(*) * 576 / (1024.0 * 1024.0) > 128 AS should_dream FROM nodes"),
    "stub_summary": with_("log", "s AS (SELECT session_id, string_agg(text, ' | ' ORDER BY id) AS s FROM log WHERE text <> '' GROUP BY session_id) SELECT session_id, CASE WHEN length(s) > 250 THEN substring(s, 1, 250) || '...' ELSE s END AS summary FROM s"),
    "block_centroids": with_("nodes", f"{_BLOCKS} SELECT block_id, n, first_ts, last_ts, sealed, pos::BIGINT AS pos, round(m, 6) + 0.0 AS m FROM facts JOIN means USING (block_id)"),
    "block_search": with_(
        "nodes asked",
        f"""{_BLOCKS}, mid AS (SELECT block_id, list(m ORDER BY pos) AS c FROM means GROUP BY block_id),
near AS (SELECT qid, qv, block_id FROM asked, mid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY list_cosine_similarity(qv, c) DESC, block_id) <= 3),
hits AS (SELECT qid, id, list_cosine_similarity(qv, v) AS s FROM near JOIN blocked USING (block_id))
SELECT qid, id, round(s, 6) + 0.0 AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id)::INT AS rank FROM hits QUALIFY rank <= 5""",
    ),
    "cache_lru_snapshot": with_("nodes", f"{_INSERTS} SELECT node_id, max(tick) AS tick FROM inserts GROUP BY node_id ORDER BY tick DESC, node_id LIMIT 64"),
    "cache_l1_l2": with_("nodes asked", f"{_INSERTS}, {_LOOKUP} SELECT qid, level, id, round(s, 6) + 0.0 AS score FROM looked"),
    "cached_navigation": beam_sql(
        3,
        first=f"{_INSERTS}, {_LOOKUP}",
        select="""SELECT qid, level, id, round(s, 6) + 0.0 AS score, 1::BIGINT AS rank FROM looked WHERE level > 0
UNION ALL SELECT qid, 0, path.id, round(path.s, 6) + 0.0, row_number() OVER (PARTITION BY qid ORDER BY path.s DESC, path.id) FROM path JOIN looked USING (qid) WHERE looked.level = 0""",
    ),
    "cache_slots": with_("nodes", f"{_INSERTS} SELECT session_id, least(count(DISTINCT node_id), 64)::BIGINT AS occupied FROM inserts GROUP BY session_id"),
    "cache_sessions_lru": with_("log", "SELECT session_id, max(id) AS tick FROM log GROUP BY session_id ORDER BY tick DESC, session_id LIMIT 20"),
}
