import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engrama.operators import cache, graph, telemetry, trace
from engrama.sources import logs, transcripts
from engrama.sources.store import Conflict, Store
from engrama.streaming import logs as stream_logs

EVENT = "id long, session_id string, role int, text string, flags int"


def events(spark, n=6, sessions=1, dead=()):
    return spark.createDataFrame([(i, f"s{i % sessions}", 0, f"t{i}", int(i in dead)) for i in range(1, n + 1)], EVENT)


def test_history_steps_over_tombstones(spark):
    e = trace.tombstone(events(spark, 4), spark.createDataFrame([(3,), (99,)], "id long"))
    assert [r["id"] for r in trace.history(e, 2).orderBy("age").collect()] == [4, 2]


def test_history_after_compaction(spark):
    e = trace.chained(events(spark, 4, dead=(3,)))
    kept = trace.compact(e, relink=False)
    assert [r["id"] for r in trace.history_until_gap(kept).collect()] == [4]
    linked = trace.compact(e).orderBy("id").collect()
    assert [(r["id"], r["prev_id"]) for r in linked] == [(1, None), (2, 1), (4, 2)]


def test_append_goes_on_from_the_tails(spark):
    log = trace.chained(events(spark, 4, 2)).select("id", "session_id", "text", "prev_id")
    new = spark.createDataFrame([(10, "s0", "x"), (11, "s2", "y"), (12, "s0", "z")], "seq long, session_id string, text string")
    got = trace.append(log, new).where("id > 4").orderBy("id").collect()
    assert [(r["id"], r["session_id"], r["prev_id"]) for r in got] == [(5, "s0", 4), (6, "s2", None), (7, "s0", 5)]


def test_prompt_history_leaves_the_question_out(spark):
    e = spark.createDataFrame([(1, "s", 0, "a", 0), (2, "s", 10, "b", 0), (3, "s", 0, "question", 0)], EVENT)
    assert [r["text"] for r in trace.prompt_history(e).orderBy("age").collect()] == ["b", "a"]


def test_roles(spark):
    df = spark.createDataFrame([("User",), ("nobody",), (None,)], "role string")
    assert [r[0] for r in df.select(trace.role_code("role")).collect()] == [0, 0, 0]
    assert [r[0] for r in df.select(trace.role_code("role", "other")).collect()] == [0, 12, 12]


def fnv(data):
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % 2**64
    return h


def test_fnv1a():
    texts = ["", "a", "foobar", "é" * 20, None, "x" * 1000]
    assert logs.fnv1a(pa.array(texts)).tolist() == [fnv((t or "").encode()) for t in texts]
    assert f"{fnv(b'foobar'):016x}" == "85944171f73967e8"


@pytest.mark.parametrize(("bad", "left"), [(None, 10), (1, 0), (4, 3)])
def test_replay_stops_at_the_first_bad_record(spark, bad, left):
    r = spark.createDataFrame([(i, f"p{i}") for i in range(1, 11)], "seq long, payload string")
    assert logs.replay(r, F.col("seq") != F.lit(bad if bad else -1)).count() == left


def test_lru_snapshot_equals_the_simulation(spark):
    rng = random.Random(2)
    log = [(t, rng.randrange(100)) for t in range(400)]
    order: dict[int, None] = {}
    for _, node in log:
        order.pop(node, None)
        order[node] = None
        if len(order) > 64:
            del order[next(iter(order))]
    df = spark.createDataFrame([(t, n, [float(n)]) for t, n in log], "tick long, node_id long, v array<double>")
    assert {r["node_id"] for r in cache.snapshot(df).collect()} == set(order)


def naive_cache(rows, slots, threshold):
    held, out = [], []
    for seq, q, node, v in rows:
        best = max(held, key=lambda e: e[1] @ q / np.linalg.norm(e[1]) / np.linalg.norm(q), default=None)
        if best is not None and best[1] @ q / np.linalg.norm(best[1]) / np.linalg.norm(q) >= threshold:
            out.append((seq, True, best[0]))
        else:
            held = [e for e in held if e[0] != node] + [(node, v)]
            held = held[-slots:]
            out.append((seq, False, node))
    return out


def test_ema_has_the_closed_form(spark):
    rows = spark.createDataFrame([("s", i, [float(x)], 1.0) for i, x in enumerate([1, 2, 3])], "session_id string, seq long, qv array<double>, best_similarity double")
    got = [r["ema"] for r in telemetry.historical_centroid(rows).orderBy("seq").collect()]
    assert got == pytest.approx([1, 5 / 3, 7 / 3])


def test_tiers(spark):
    hit = "qid long, id long, score double"
    local = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.5)], hit)
    cloud = spark.createDataFrame([(0, 2, 0.7), (0, 3, 0.6)], hit)
    assert [(r["id"], r["score"]) for r in telemetry.merge_tiers(local, cloud).orderBy("rank").collect()] == [(1, 0.9), (2, 0.7), (3, 0.6)]
    q = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    cold = telemetry.cold_misses(q, spark.createDataFrame([(0, 1, 0.64), (1, 1, 0.65)], hit)).orderBy("qid").collect()
    assert [r["needs_cloud"] for r in cold] == [True, False, True]


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, "CAUSAL"), (2, 3, "CAUSAL"), (1, 9, "REF"), (2, 9, "REF"), (2, 8, "REF"), (3, 8, "REF"), (5, 7, "REF")], "src long, dst long, relation string")
    got = {(r["id"], r["ancestor"], r["distance"]) for r in graph.ancestors(e).collect()}
    assert got == {(2, 1, 1), (3, 2, 1), (3, 1, 2)}
    clusters = {r["id"]: r["cluster"] for r in graph.shared_anchor_clusters(e).collect()}
    assert clusters == {1: 1, 2: 1, 3: 1, 5: 5}


def test_graph_long_chains(spark):
    n = 400
    causal = [(i, i + 1, "CAUSAL") for i in range(n)]
    refs = [(i, n + j, "REF") for i in range(n) for j in (i, i + 1)]
    e = spark.createDataFrame(causal + refs, "src long, dst long, relation string")
    got = graph.ancestors(e).agg(F.count("*"), F.countDistinct("id", "ancestor"), F.max("distance"), F.count_if(F.col("distance") != F.col("id") - F.col("ancestor"))).first()
    assert tuple(got) == (n * (n + 1) // 2, n * (n + 1) // 2, n, 0)
    clusters = {r["id"]: r["cluster"] for r in graph.shared_anchor_clusters(e).collect()}
    assert clusters == dict.fromkeys(range(n), 0)


def test_ancestors_by_the_shortest_way(spark):
    rng = random.Random(6)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(50)}
    want, level = {}, {(dst, src) for src, dst in pairs}
    while level:
        d = 1 + max(want.values(), default=0)
        want |= dict.fromkeys(level, d)
        level = {(i, src) for i, via in level for src, dst in pairs if dst == via} - want.keys()
    e = spark.createDataFrame([(*p, "CAUSAL") for p in pairs], "src long, dst long, relation string")
    assert {(r["id"], r["ancestor"]): r["distance"] for r in graph.ancestors(e).collect()} == want


def test_store_generations(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    schema = "id long, flags int, text string"
    row = lambda *ids, flags=0: spark.createDataFrame([(i, flags, f"t{i}") for i in ids], schema)
    s = Store(spark, path, schema, {"dim": 4})
    assert s.generation == 0 and s.read().count() == 0 and s.compact() == 0
    s.append(row(1, 2))
    s.append(row(3, flags=1))
    old = s.read()
    assert s.read().count() == 3 and s.get(2).first()["text"] == "t2"
    assert s.compact() == 1
    assert sorted(r["id"] for r in s.read().collect()) == [1, 2] and old.count() == 3
    again = Store(spark, path, schema, {"dim": 99})
    assert again.meta["dim"] == 4 and again.generation == 1


def test_store_loses_nothing_while_it_compacts(spark, tmp_path):
    schema = "id long, flags int, text string"
    row = lambda i, flags=0: spark.createDataFrame([(i, flags, f"t{i}")], schema)
    s = Store(spark, f"file://{tmp_path}/store", schema)
    s.append(row(1))
    s.append(row(2, 1))
    at = s.snapshot()
    kept = s.read(at).where("flags = 0")
    s.append(row(3))
    assert s.publish(kept, at) == 1
    assert sorted(r["id"] for r in s.read().collect()) == [1, 3]
    with pytest.raises(Conflict):
        s.publish(kept, at)
    assert sorted(r["id"] for r in s.read().collect()) == [1, 3] and s.compact() == 2
    assert sorted(r["id"] for r in s.read().collect()) == [1, 3] and s.compact() == 2


def test_log_is_recovered_and_truncated(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"payload {i}") for i in range(1, 9)], "seq long, payload string")
    path = f"file://{tmp_path}/wal"
    logs.append(rows.where("seq <= 4"), path, 1)
    logs.append(rows.where("seq > 4"), path, 1)
    log = spark.read.parquet(path)
    assert logs.recover(log, 1).count() == 8 and logs.recover(log, 2).count() == 0
    torn = log.withColumn("size", F.when(F.col("seq") == 6, F.col("size") + 1).otherwise(F.col("size")))
    assert sorted(r["seq"] for r in logs.recover(torn, 1).collect()) == [1, 2, 3, 4, 5]
    logs.truncate(log, 5, f"{path}-2")
    assert sorted(r["seq"] for r in logs.recover(spark.read.parquet(f"{path}-2"), 1).collect()) == [6, 7, 8]


def test_previews_stand_in_for_missing_texts(spark):
    e = spark.createDataFrame([(1, "whole", "who"), (2, None, "pre"), (3, "", "pre"), (4, None, None)], "id long, text string, text_preview string")
    assert [r["full_text"] for r in trace.full_text(e).orderBy("id").collect()] == ["whole", "pre", "pre", None]
    assert trace.history(events(spark, 3), 0).count() == 1


def test_sessions_round_trip(spark, tmp_path):
    schema = "session_id string, turns array<struct<role: string, text: string>>"
    rows = [("a", [("user", "q"), ("assistant", "x")]), ("b", [])]
    transcripts.save_sessions(spark.createDataFrame(rows, schema), str(tmp_path / "s"))
    assert sorted((r[0], [tuple(t) for t in r[1]]) for r in transcripts.load_sessions(spark, str(tmp_path / "s"), schema).collect()) == rows


def test_store_refuses_unknown_versions(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    Store(spark, path, "id long", {"version": 9})
    with pytest.raises(ValueError, match="version"):
        Store(spark, path, "id long")


def test_transcripts_round_trip(spark, tmp_path):
    e = events(spark, 3).withColumn("ts", F.timestamp_seconds(F.col("id")))
    transcripts.save_turns(e, str(tmp_path / "t"))
    (tmp_path / "t" / "junk.json").write_text("not json\n")
    got = transcripts.read_turns(spark, str(tmp_path / "t"))
    assert sorted((r["session_id"], r["role"], r["text"]) for r in got.collect()) == [("s0", 0, "t1"), ("s0", 0, "t2"), ("s0", 0, "t3")]
    assert [r["text"] for r in transcripts.latest(got, 2).orderBy("age").collect()] == ["t3", "t2"]
    users = spark.createDataFrame([("ok_1-x",), ("../x",), ("",), (None,)], "user_id string")
    assert [r[0] for r in transcripts.valid_users(users).collect()] == ["ok_1-x"]


def test_append_stream_is_exactly_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"s{i % 2}", f"t{i}") for i in range(6)], "seq long, session_id string, text string")
    rows.where("seq < 3").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    store = str(tmp_path / "log")
    stream = lambda: spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    stream_logs.append_stream(stream(), store, str(tmp_path / "c")).awaitTermination()
    rows.where("seq >= 3").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    stream_logs.append_stream(stream(), store, str(tmp_path / "c")).awaitTermination()
    stream_logs.append_stream(stream(), store, str(tmp_path / "c")).awaitTermination()
    got = stream_logs.read_log(spark, store).orderBy("id").collect()
    assert [(r["id"], r["prev_id"], r["text"]) for r in got] == [(1, None, "t0"), (2, None, "t1"), (3, 1, "t2"), (4, 2, "t3"), (5, 3, "t4"), (6, 4, "t5")]


def test_dreaming_stream(spark, tmp_path):
    schema = "id long, parent_id long, v array<double>, flags int, hub_penalty double, metadata string"
    s = Store(spark, f"file://{tmp_path}/store", schema)
    s.append(spark.createDataFrame([(i, 0 if i else None, [1.0], int(i > 12), 0.0, f"m{i}") for i in range(20)], schema))
    spark.range(1).write.parquet(str(tmp_path / "ticks"))
    ticks = spark.readStream.schema("id long").parquet(str(tmp_path / "ticks"))
    stream_logs.dreaming(ticks, s, 128, 768, str(tmp_path / "c"), availableNow=True).awaitTermination()
    assert s.generation == 1
    assert sorted(r["id"] for r in s.read().collect()) == [0, 1]
