import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engrama.operators import blocks, dream, knn, tree

SCHEMA = "id long, parent_id long, v array<double>, flags int, hub_penalty double, metadata string"


def store(spark, rows):
    return spark.createDataFrame([(i, p, [float(x) for x in v], f, 1e9 if f & 1 else 0.0, m) for i, p, v, f, m in rows], SCHEMA)


def queries(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "qid long, qv array<double>").withColumn("v", F.col("qv"))


def test_nearest_child_first(spark):
    n = store(spark, [(0, None, [0] * 8, 0, "root"), (1, 0, [1] * 8, 0, "up"), (2, 0, [-1] * 8, 0, "down")])
    got = tree.navigate(queries(spark, [[1] * 8]), n, None, 1).orderBy("rank").collect()
    assert [(r["id"], round(r["score"], 6)) for r in got] == [(1, 1.0), (0, 0.0)]


def test_children_with_previews_and_unknown_parents(spark):
    n = store(spark, [(0, None, [0] * 4, 0, "r"), (1, 0, [1, 0, 0, 0], 0, "a"), (2, 0, [0, 1, 0, 0], 0, "b")])
    got = {r["id"]: r["preview"] for r in tree.children(n, spark.createDataFrame([(0,)], "parent_id long")).collect()}
    assert got == {1: [1.0, 0.0, 0.0], 2: [0.0, 1.0, 0.0]}
    assert tree.children(n, spark.createDataFrame([(99999,)], "parent_id long")).count() == 0


def simulated_links(parents):
    """A child joins its parent's run only right behind the run's end."""
    first, count, out = {}, {}, []
    for i, p in enumerate(parents):
        if p is None:
            out.append(False)
        elif p not in first:
            first[p], count[p] = i, 1
            out.append(True)
        elif i == first[p] + count[p]:
            count[p] += 1
            out.append(True)
        else:
            out.append(False)
    return out


def test_linked_equals_the_simulation(spark):
    rng = random.Random(5)
    for _ in range(5):
        parents = [None] + [rng.choice([i - 1, rng.randrange(i)]) for i in range(1, 60)]
        n = store(spark, [(i, p, [0], 0, "") for i, p in enumerate(parents)])
        got = [r["linked"] for r in tree.linked(n).orderBy("id").collect()]
        assert got == simulated_links(parents)


def beam(vectors, parents, dead, q, width):
    unit = lambda v: v / np.linalg.norm(v) if np.linalg.norm(v) > 0 else v
    s = [float(unit(v) @ unit(q)) for v in vectors]
    level, path = [0], [0]
    while True:
        kids = sorted((i for i, p in enumerate(parents) if p in level and i not in dead), key=lambda i: (-s[i], i))
        if not kids:
            return path
        level = kids[:width]
        path.append(level[0])


@pytest.mark.parametrize("width", [0, 1, 3, 99])
def test_beam_equals_the_simulation(spark, width):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(80, 8))
    parents = [None] + [(i - 1) // 3 for i in range(1, 80)]
    dead = {i for i in range(80) if i % 10 == 7}
    n = store(spark, [(i, p, v, int(i in dead), "") for i, (p, v) in enumerate(zip(parents, vectors, strict=True))])
    qs = rng.normal(size=(4, 8))
    got = tree.beam_path(queries(spark, qs), n, width).orderBy("qid", "level").collect()
    want = [(k, i) for k, q in enumerate(qs) for i in beam(vectors, parents, dead, q, max(1, min(width, 16)))]
    assert [(r["qid"], r["id"]) for r in got] == want


def test_deep_tree(spark):
    """A chain, a cycle, a node under it and one under no node; the beam goes below level 64."""
    rows = [(i, i - 1 if i else None, [1, i], 0, "") for i in range(400)]
    lost = [(500, 501, [1, 0], 0, ""), (501, 500, [1, 0], 0, ""), (502, 501, [1, 0], 0, ""), (600, 999, [1, 0], 0, "")]
    assert {r["id"]: r["depth"] for r in tree.depths(store(spark, rows + lost)).collect()} == {i: i for i in range(400)}
    got = tree.beam_path(queries(spark, [[1, 0]]), store(spark, rows[:70])).orderBy("level").collect()
    assert [(r["level"], r["id"]) for r in got] == [(i, i) for i in range(70)]


def test_empty_store(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tree.navigate(queries(spark, [[1, 0]]), empty).count() == 0
    assert tree.depths(empty).count() == 0
    assert knn.knn(queries(spark, [[1, 0]]), empty, 3).count() == 0


def test_prune_more_than_there_is(spark):
    n = store(spark, [(i, None, [1], 0, "") for i in range(3)])
    assert tree.prune_delta(n, 5).count() == 0
    assert [r["id"] for r in tree.prune_delta(n, 1).orderBy("id").collect()] == [0, 1]


def test_consolidate_and_compact(spark):
    n = store(spark, [(0, None, [0], 0, "r"), (1, 0, [1], 0, "a"), (2, 0, [2], 0, "b"), (3, 1, [3], 0, "c"), (4, 2, [4], 0, "d"), (5, 4, [5], 0, "e")])
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r["id"]: (r["parent_id"], r["flags"]) for r in tree.consolidate(n, ids, [9.0], "s").collect()}
    assert got == {0: (None, 0), 1: (0, 1), 2: (0, 1), 3: (6, 0), 4: (6, 0), 5: (4, 0), 6: (0, 2)}
    compacted = {r["id"]: (r["old_id"], r["parent_id"]) for r in tree.compact(tree.consolidate(n, ids, [9.0], "s")).collect()}
    assert compacted == {0: (0, None), 1: (3, 4), 2: (4, 4), 3: (5, 2), 4: (6, 0)}


def test_consolidate_refuses(spark):
    n = store(spark, [(0, None, [0], 0, "r"), (1, 0, [1], 1, "dead")])
    for ids, said in (([], "no ids"), ([7], "unknown"), ([1], "dead")):
        with pytest.raises(ValueError, match=said):
            tree.consolidate(n, spark.createDataFrame([(i,) for i in ids], "id long"), [0.0], "")


def test_numbered_counts_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    got = tree.numbered(df, "k", "n").collect()
    assert all(r["k"] == r["n"] for r in got) and len(got) == 1000


def test_pressure_and_summary(spark):
    rows = lambda dead: store(spark, [(i, None, [0], int(i < dead), "") for i in range(100)])
    assert dream.pressure(rows(26), 128, 768).first()["should_dream"]
    assert not dream.pressure(rows(25), 128, 768).first()["should_dream"]
    assert dream.pressure(rows(0), 0.1, 768).first()["should_dream"]
    long = spark.createDataFrame([(0, 1, "x" * 300), (1, 1, "a"), (1, 2, ""), (1, 3, "b")], "g int, id long, text string")
    got = {r["g"]: r["summary"] for r in dream.stub_summaries(long, "g", "id").collect()}
    assert got == {0: "x" * 250 + "...", 1: "a | b"}


@pytest.mark.parametrize("n", [63, 64, 65, 2000])
def test_summary_gathers_no_more_than_shows(spark, n):
    df = spark.createDataFrame([(0, i, "abc"[i % 3]) for i in range(n)], "g int, id long, text string").repartition(3)
    got = dream.stub_summaries(df, "g", "id")
    s = " | ".join("abc"[i % 3] for i in range(n))
    assert got.first()["summary"] == (s[:250] + "..." if len(s) > 250 else s)
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_dream_skips_small_stores(spark):
    n = store(spark, [(i, 0 if i else None, [1], 0, "m") for i in range(9)])
    after, report = dream.dream(n)
    assert not report.first()["ran"] and after.count() == 9


def test_block_search_equals_exact_when_all_blocks_are_open(spark):
    rng = np.random.default_rng(8)
    rows = [(i, i, float(i), rng.normal(size=4).tolist()) for i in range(100)]
    v = spark.createDataFrame(rows, "seq long, id long, ts double, v array<double>")
    q = queries(spark, rng.normal(size=(3, 4)))
    got = sorted((r["qid"], r["id"]) for r in blocks.search(q, v, 5, 16, 10).collect())
    assert got == sorted((r["qid"], r["id"]) for r in knn.knn(q, v, 5).collect())
    assert blocks.centroids(v, 64).orderBy("block_id").select("n", "sealed").collect() == [(64, True), (36, False)]


def test_knn_ties_blocks_and_odd_vectors(spark):
    n = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(10)] + [(10, [0.0, 0.0]), (11, None), (12, [1.0])], "id long, v array<double>")
    q = queries(spark, [[1, 0]] * 3)
    got = knn.knn(q, n, 3, block=2).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"]) for r in got] == [(k, i) for k in range(3) for i in range(3)]
    assert knn.knn(q.limit(1), n, 50).count() == 12


def test_knn_in_many_blocks_equals_one_product(spark):
    rng = np.random.default_rng(9)
    x, y = rng.integers(-3, 4, (300, 5)).astype(float), rng.integers(-3, 4, (40, 5)).astype(float)
    n = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(300, [1.0] * 4)], "id long, v array<double>").repartition(5)
    scores = y @ x.T
    for block in (7, 64, 4096):
        got = {(r["qid"], r["rank"]): (r["id"], r["score"]) for r in knn.knn(queries(spark, y), n, 6, "dot", block).collect()}
        for q, own in enumerate(scores):
            best = sorted(((-s, i) for i, s in enumerate(own)))[:6]
            assert [got[q, k + 1] for k in range(6)] == [(i, -s) for s, i in best]
    near = knn.similar_above(queries(spark, y), n, 0.9, 16).count()
    norm = np.linalg.norm(y, axis=1)[:, None] * np.linalg.norm(x, axis=1)
    assert near == (scores > 0.9 * norm + 1e-12)[norm > 0].sum() if norm.all() else near > 0


def test_knn_of_copies_takes_the_smallest_ids(spark):
    """Equal vectors have equal scores wherever they lie in a block, and whatever longer vectors lie beside them."""
    rng = np.random.default_rng(11)
    base, y = rng.normal(size=(37, 64)), rng.normal(size=(50, 64))
    rows = [(i, base[i % 37].tolist()) for i in range(37 * 40)]
    n = spark.createDataFrame([*rows, (9000, [1.0] * 71)], "id long, v array<double>").coalesce(1)
    want = np.argmax(y @ (base / np.linalg.norm(base, axis=1)[:, None]).T, axis=1)
    for block in (128, 2048):
        got = knn.knn(queries(spark, y), n, 30, block=block).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
        assert all(r["ids"] == [int(want[r["qid"]]) + 37 * j for j in range(30)] for r in got) and len(got) == 50


def test_a_pair_of_blocks_is_scored_in_little_memory():
    """The scores of two full blocks would be 32 MB; long vectors make smaller blocks, and best hits are passed on by bytes."""
    import pyarrow as pa
    import tracemalloc

    rng = np.random.default_rng(12)
    x = rng.normal(size=(2, knn.BLOCK, 64))
    sizes = np.full(knn.BLOCK, 64, np.int32)
    columns = [pa.array([a.tobytes()], pa.binary()) for v in x for a in (np.arange(knn.BLOCK), sizes, v)]
    b = pa.RecordBatch.from_arrays(columns, list("abcdef"))
    tracemalloc.start()
    scores, ids = knn._Pair(b, 0).best(5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20
    want = np.sort(x[0] @ x[1].T, axis=1)[:, ::-1][:, :5]
    assert np.allclose(scores, want) and np.allclose(scores, np.einsum("qd,qkd->qk", x[0], x[1][ids]))


def test_long_vectors_make_small_blocks(spark):
    n = spark.range(300).select("id", F.array_repeat(F.lit(1.0), 16384).alias("v")).coalesce(1)
    rows = knn._blocks(n, "id", "cosine", knn.BLOCK).select(F.octet_length("ids") / 8, F.octet_length("vectors")).collect()
    assert sum(r[0] for r in rows) == 300 and max(r[1] for r in rows) <= 4 << 20


def test_insert_checks(spark):
    n = store(spark, [(0, None, [0, 0], 0, "r")])
    new = lambda *rows: spark.createDataFrame(rows, "seq long, parent_id long, v array<double>, metadata string")
    got = tree.insert(n, new((5, 0, [1.0, 2.0], "é" * 200), (9, None, [3.0, 4.0], "root")), 2).orderBy("id").collect()
    assert [(r["id"], r["parent_id"]) for r in got] == [(0, None), (1, 0), (2, None)]
    assert got[1]["metadata"] == "é" * 127
    for row, said in (((1, 0, [1.0], "m"), "dimension"), ((1, 99999, [1.0, 2.0], "m"), "unknown parent"), ((1, 0, None, "m"), "dimension")):
        with pytest.raises(Exception, match=said):
            tree.insert(n, new(row), 2).collect()


def test_delta_ids_have_the_highest_bit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    rows = spark.createDataFrame([(k, [1.0] * (2 if k else 3), "m") for k in range(3)], "seq long, v array<double>, metadata string")
    got = tree.insert_delta(empty, rows, 2).orderBy("id").collect()
    assert [r["id"] & (2**64 - 1) for r in got] == [2**63, 2**63 + 1, 2**63 + 2]
    assert got[0]["v"] == [0.0, 0.0] and got[2]["v"] == [1.0, 1.0]
    assert tree.prune_delta(tree.insert_delta(empty, rows, 2), 1).count() == 2


def test_manual_consolidation_needs_two(spark):
    n = store(spark, [(0, None, [1, 0], 0, "r"), (1, 0, [1, 0], 0, "a"), (2, 0, [0, 1], 0, "b")])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    with pytest.raises(ValueError, match="two"):
        tree.summarize_and_consolidate(n, ids(1))
    new = tree.summarize_and_consolidate(n, ids(1, 2)).where("id = 3").first()
    assert new["metadata"] == "a | b" and new["v"] == pytest.approx([0.5**0.5] * 2)


def test_warming_a_cache(spark):
    from engrama.operators import cache

    n = store(spark, [(0, None, [1, 0], 0, "r"), (1, 0, [0, 1], 0, "a")])
    warm = tree.load_context(n, spark.createDataFrame([(1, 7), (99, 8)], "id long, tick long"))
    assert [(r["node_id"], r["tick"]) for r in cache.snapshot(warm).collect()] == [(1, 7)]
