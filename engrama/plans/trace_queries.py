"""The episodic log, its write-ahead log, and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.operators import telemetry, trace
from engrama.operators.knn import knn
from engrama.sources import logs

from . import fixtures as fx
from .fixtures import with_
from .vector_queries import r6


def trace_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even conversations are the log; the others come in and go on after it, one turn each under an even one's session."""
    e = fx.events(spark, sf_dir)
    even = F.floor((F.col("id") - 1) / fx.TURNS) % 2 == 0
    log = trace.chained(e.where(even)).select("id", "session_id", "text", "prev_id")
    odd = e.where(~even)
    joined = F.when(F.col("turn") == 0, F.concat(F.lit("conv-"), (F.floor((F.col("id") - 1) / fx.TURNS) - 1).cast("string"))).otherwise(F.col("session_id"))
    new = odd.select(F.col("id").alias("seq"), joined.alias("session_id"), "text")
    return trace.append(log, new).select("id", "session_id", "prev_id")


def _layers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base and delta of the log: the last turns are in the delta, and so is a second version of each ninth event of the base."""
    e = fx.events(spark, sf_dir)
    again = e.where("turn < 4 and id % 9 = 0").withColumn("text", F.lit("second version"))
    return e.where("turn < 4"), e.where("turn >= 4").unionByName(again)


def resolve_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.events(spark, sf_dir).where("id % 3 = 0").select("id").union(spark.range(1, 4))
    return trace.resolve(asked, *_layers(spark, sf_dir)).select("id", "layer", "text")


def trace_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.sizes(*_layers(spark, sf_dir))


def has_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, delta = _layers(spark, sf_dir)
    return trace.has_sessions(base.select("session_id"), delta.where("text <> 'second version'"))


def session_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.tails(fx.events(spark, sf_dir))


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.history(fx.events(spark, sf_dir).withColumn("flags", F.lit(0)), 3).select("session_id", "id", "age", "text")


def history_tombstoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).withColumn("flags", F.lit(0))
    dead = trace.tombstone(e, e.where("id % 3 = 0").select("id"))
    return trace.history(dead, 3).select("session_id", "id", "age")


def history_compat_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trace.chained(fx.events(spark, sf_dir))
    return trace.history_until_gap(trace.compact(e, relink=False), 100).select("session_id", "id", "age")


def trace_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.compact(fx.events(spark, sf_dir)).select("id", "session_id", "prev_id")


def drop_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir)
    return trace.drop_sessions(e, e.where("flags = 1").select("session_id")).select("id", "session_id")


def blob_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.blob_offsets(trace.previews(fx.events(spark, sf_dir))).select("id", F.col("blob_size").cast("long").alias("blob_size"), "blob_offset")


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.table(spark, sf_dir, "documents").where("text is not null")
    return trace.previews(d.select("doc_id", "text")).select("doc_id", "text_preview", F.col("blob_size").cast("long").alias("blob_size"))


def role_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "conversations").select(trace.role_code("role", "other").alias("code"))
    return c.groupBy("code").agg(F.count("*").alias("n")).select("code", trace.role_name("code").alias("name"), "n")


def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.prompt_history(fx.events(spark, sf_dir), 4).select("session_id", "id", "age")


def grounded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.grounded(fx.events(spark, sf_dir), fx.nodes(spark, sf_dir)).select("id", "concept_id", "concept")


def gc_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.events(spark, sf_dir).groupBy("role").agg(F.count("*").alias("before"), F.count_if(F.col("flags") == 0).alias("after"))
    return e.select("role", "before", "after", r6(1 - F.col("after") / F.col("before")).alias("gc_ratio"))


def wal_replay_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = (F.col("checksum") == F.md5("payload")) & (F.col("seq") > 0)
    return logs.replay(fx.log_records(spark, sf_dir), valid).select("seq", "payload")


def wal_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with its own checksums, of which some payloads have been damaged since."""
    log = logs.framed(fx.log_records(spark, sf_dir), 2)
    damaged = F.when(F.col("seq") % 5000 == 601, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    return logs.recover(log.withColumn("payload", damaged), 2)


def wal_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of every record; no SQL, as its arithmetic wraps."""
    return logs.with_fnv1a(fx.log_records(spark, sf_dir).select("seq", "payload")).select("seq", "fnv1a")


def cold_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.asked(spark, sf_dir)
    hits = knn(q, fx.nodes(spark, sf_dir).where("id % 4 <> 0"), 3)
    return telemetry.cold_misses(q, hits).select("qid", r6("best").alias("best"), "needs_cloud")


def merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir)
    local = knn(q, n.where("id % 3 <> 0"), 5).withColumn("score", F.col("score") * 0.9)
    merged = telemetry.merge_tiers(local, knn(q, n.where("id % 3 <> 1"), 5))
    return merged.select("qid", "id", r6("score").alias("score"))


def tiered_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir)
    out = telemetry.tiered(q, knn(q, n.where("id % 4 <> 0"), 3), knn(q, n.where("id % 4 = 0"), 3))
    return out.select("qid", "id", r6("score").alias("score"), "needs_cloud", "hit")


def cloud_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.asked(spark, sf_dir)
    flags = telemetry.cold_misses(q, knn(q, fx.nodes(spark, sf_dir).where("id % 4 <> 0"), 1))
    return flags.agg(F.count("*").alias("queries"), r6(F.avg(F.col("needs_cloud").cast("double"))).alias("cloud_rate"))


def hit_rate_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.telemetry(spark, sf_dir).withColumn("hit", F.col("best_similarity") >= telemetry.COLD)
    return telemetry.rolling_hit_rate(t, 100).select("session_id", "seq", "hit", r6("hit_rate").alias("hit_rate"))


def ema_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = telemetry.historical_centroid(fx.telemetry(spark, sf_dir))
    return e.select("session_id", "seq", F.col("pos").cast("long").alias("pos"), r6("ema").alias("ema"))


def recent_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = telemetry.recent_mean(fx.telemetry(spark, sf_dir))
    return m.select("session_id", "seq", F.col("pos").cast("long").alias("pos"), r6("mean").alias("mean"))


def drift_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.drift(fx.telemetry(spark, sf_dir)).select("session_id", "seq", F.round("drift", 8).alias("drift"))


def drift_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = telemetry.alerts(fx.telemetry(spark, sf_dir))
    return a.select("session_id", "seq", "hit", r6("hit_rate").alias("hit_rate"), F.round("drift", 8).alias("drift"), "alert")


def semantic_inertia(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.nodes(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("session_id"), F.col("id").alias("seq"), "v")
    return telemetry.inertia(t, 0.05).select("session_id", "pairs", r6("inertia").alias("inertia"))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = telemetry.latency_summary(fx.table(spark, sf_dir, "events").where("value is not null"), "event_type", "value")
    return s.select("event_type", "n", r6("mean").alias("mean"), r6("stddev").alias("stddev"), "p50", "p90", "p99")


def embedded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the vector of the embedding that their id names, modulo their number: the events that have vectors."""
    n = fx.nodes(spark, sf_dir)
    count = n.agg(F.count("*")).first()[0]
    return fx.events(spark, sf_dir).where("role = 0").select("id", (F.col("id") % count).alias("vid")).join(n.select(F.col("id").alias("vid"), "v"), "vid").select("id", "v")


_TOP = "ranked AS (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS k FROM (SELECT qid, id, list_cosine_similarity(qv, v) AS s FROM asked, nodes WHERE {0}))"
_POS = "parts AS (SELECT session_id, seq, generate_subscripts(qv, 1) - 1 AS pos, unnest(qv) AS x FROM telemetry)"
_MEANS = """steps AS (SELECT session_id, seq, pos, x, row_number() OVER w AS n, avg(x) OVER (w ROWS 99 PRECEDING) AS mean FROM parts WINDOW w AS (PARTITION BY session_id, pos ORDER BY seq)),
mixed_ AS (SELECT *, 2.0::DOUBLE / (n * (n + 1)) * sum(n * x) OVER (PARTITION BY session_id, pos ORDER BY seq) AS ema FROM steps)"""
_DRIFT = """exps AS (SELECT session_id, seq, pos, n, exp(mean - max(mean) OVER (PARTITION BY session_id, seq)) AS a, exp(ema - max(ema) OVER (PARTITION BY session_id, seq)) AS b FROM mixed_),
soft AS (SELECT session_id, seq, n, a / (sum(a) OVER (PARTITION BY session_id, seq) + 1e-12) AS p, b / (sum(b) OVER (PARTITION BY session_id, seq) + 1e-12) AS q FROM exps),
mids AS (SELECT *, (p + q) * 0.5 AS m FROM soft),
drifts AS (SELECT session_id, seq, CASE WHEN max(n) >= 100 THEN 0.5 * sum(p * ln((p + 1e-12) / (m + 1e-12))) + 0.5 * sum(q * ln((q + 1e-12) / (m + 1e-12))) ELSE 0.0::DOUBLE END AS drift FROM mids GROUP BY session_id, seq)"""

QUERIES = {f.__name__: f for f in (trace_append, resolve_events, trace_sizes, has_session, session_tails, session_history, history_tombstoned, history_compat_gap, trace_compact, drop_session, blob_offsets, text_preview, role_map, prompt_history, grounded_events, gc_ratio, wal_replay_prefix, wal_recover, wal_checksums, cold_miss, merge_dedupe, tiered_query, cloud_rate, hit_rate_rolling, ema_centroid, recent_mean, drift_jsd, drift_alerts, semantic_inertia, latency_summary)}
SQL = {
    "trace_append": with_(
        "log",
        f"""parts AS (SELECT *, (id - 1) // {fx.TURNS} AS conv FROM log), old AS (SELECT id, session_id FROM parts WHERE conv % 2 = 0),
new AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY id) AS id, CASE WHEN turn = 0 THEN 'conv-' || (conv - 1) ELSE session_id END AS session_id FROM parts WHERE conv % 2 = 1),
mixed_ AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT id, session_id, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS prev_id FROM mixed_""",
    ),
    "resolve_events": with_("log", "SELECT id, CASE WHEN turn < 4 THEN 0 ELSE 1 END AS layer, text FROM log WHERE id % 3 = 0 OR id BETWEEN 1 AND 3"),
    "trace_sizes": with_("log", "SELECT count(*) + count_if(turn < 4 AND id % 9 = 0)::BIGINT AS total, count_if(turn < 4)::BIGINT AS base, (count_if(turn >= 4) + count_if(turn < 4 AND id % 9 = 0))::BIGINT AS delta FROM log"),
    "has_session": with_("log", "SELECT session_id, max(turn) >= 4 AS has FROM log GROUP BY session_id HAVING min(turn) < 4"),
    "session_tails": with_("log", "SELECT session_id, max(id) AS tail_id, count(*) AS n_events FROM log WHERE flags = 0 GROUP BY session_id"),
    "session_history": with_("log", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC)::INT AS age, text FROM log QUALIFY age <= 3"),
    "history_tombstoned": with_("log", "SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC)::INT AS age FROM log WHERE id % 3 <> 0 QUALIFY age <= 3"),
    "history_compat_gap": with_(
        "log",
        """chain AS (SELECT *, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS prev FROM log), live AS (SELECT * FROM chain WHERE flags = 0),
gaps AS (SELECT session_id, id, prev IS NOT NULL AND prev NOT IN (SELECT id FROM live) AS gap FROM live),
runs AS (SELECT session_id, id, coalesce(sum(gap::INT) OVER (PARTITION BY session_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS broken FROM gaps)
SELECT session_id, id, row_number() OVER (PARTITION BY session_id ORDER BY id DESC)::INT AS age FROM runs WHERE broken = 0""",
    ),
    "trace_compact": with_("log", "SELECT id, session_id, lag(id) OVER (PARTITION BY session_id ORDER BY id) AS prev_id FROM log WHERE flags = 0"),
    "drop_session": with_("log", "SELECT id, session_id FROM log WHERE session_id NOT IN (SELECT session_id FROM log WHERE flags = 1)"),
    "blob_offsets": with_("log", "SELECT id, octet_length(encode(text))::BIGINT AS blob_size, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS blob_offset FROM log"),
    "text_preview": "SELECT doc_id, substring(text, 1, list_max(list_filter(range(0, 64), lambda k: k <= length(text) AND octet_length(encode(substring(text, 1, k))) <= 63))) AS text_preview, octet_length(encode(text))::BIGINT AS blob_size FROM documents WHERE text IS NOT NULL",
    "role_map": with_("log", "SELECT role AS code, CASE role WHEN 0 THEN 'user' WHEN 1 THEN 'system' WHEN 2 THEN 'concept' WHEN 3 THEN 'summary' WHEN 10 THEN 'assistant' WHEN 11 THEN 'tool' ELSE 'other' END AS name, count(*) AS n FROM log GROUP BY role"),
    "prompt_history": with_(
        "log",
        """r AS (SELECT session_id, id, role, row_number() OVER (PARTITION BY session_id ORDER BY id DESC) AS age FROM log WHERE flags = 0),
a AS (SELECT *, max((age = 1 AND role = 0)::INT) OVER (PARTITION BY session_id) AS asked FROM r) SELECT session_id, id, (age - asked)::INT AS age FROM a WHERE age > asked AND age <= asked + 4""",
    ),
    "grounded_events": with_("log nodes", "SELECT log.id, concept_id, metadata AS concept FROM log LEFT JOIN nodes ON nodes.id = concept_id"),
    "gc_ratio": with_("log", "SELECT role, count(*) AS before, count_if(flags = 0)::BIGINT AS after, round(1 - count_if(flags = 0) / count(*), 6) + 0.0 AS gc_ratio FROM log GROUP BY role"),
    "wal_replay_prefix": with_("records", "SELECT seq, payload FROM records WHERE seq < coalesce((SELECT min(seq) FROM records WHERE checksum <> md5(payload) OR payload IS NULL), 9223372036854775807)"),
    "wal_recover": with_("records", "SELECT seq, payload FROM records WHERE seq < coalesce((SELECT min(seq) FROM records WHERE seq % 5000 = 601 OR payload IS NULL), 9223372036854775807)"),
    "cold_miss": with_("asked nodes", f"{_TOP.format('id % 4 <> 0')} SELECT qid, round(greatest(0.0, s), 6) + 0.0 AS best, s < 0.65 AS needs_cloud FROM ranked WHERE k = 1"),
    "merge_dedupe": with_(
        "asked nodes",
        """scored AS (SELECT qid, id, list_cosine_similarity(qv, v) AS s FROM asked, nodes),
l AS (SELECT qid, id, s * 0.9::DOUBLE AS s FROM scored WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY scored.s DESC, id) <= 5),
c AS (SELECT qid, id, s FROM scored WHERE id % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 5)
SELECT qid, id, round(max(s), 6) + 0.0 AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM c) GROUP BY qid, id""",
    ),
    "tiered_query": with_(
        "asked nodes",
        """scored AS (SELECT qid, id, list_cosine_similarity(qv, v) AS s FROM asked, nodes),
l AS (SELECT qid, id, s FROM scored WHERE id % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 3),
c AS (SELECT qid, id, s FROM scored WHERE id % 4 = 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= 3),
f AS (SELECT qid, greatest(0.0, max(s)) < 0.65 AS cold FROM l GROUP BY qid),
m AS (SELECT * FROM l UNION ALL SELECT c.* FROM c JOIN f USING (qid) WHERE cold)
SELECT qid, id, round(s, 6) + 0.0 AS score, cold AS needs_cloud, max(s) OVER (PARTITION BY qid) >= 0.65 AS hit FROM m JOIN f USING (qid)""",
    ),
    "cloud_rate": with_("asked nodes", f"{_TOP.format('id % 4 <> 0')} SELECT count(*) AS queries, round(avg((s < 0.65)::INT), 6) + 0.0 AS cloud_rate FROM ranked WHERE k = 1"),
    "hit_rate_rolling": with_("telemetry", "SELECT session_id, seq, best_similarity >= 0.65 AS hit, round(avg((best_similarity >= 0.65)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS 99 PRECEDING), 6) + 0.0 AS hit_rate FROM telemetry"),
    "ema_centroid": with_("telemetry", f"{_POS}, {_MEANS} SELECT session_id, seq, pos::BIGINT AS pos, round(ema, 6) + 0.0 AS ema FROM mixed_"),
    "recent_mean": with_("telemetry", f"{_POS}, {_MEANS} SELECT session_id, seq, pos::BIGINT AS pos, round(mean, 6) + 0.0 AS mean FROM mixed_ WHERE n >= 100"),
    "drift_jsd": with_("telemetry", f"{_POS}, {_MEANS}, {_DRIFT} SELECT session_id, seq, round(drift, 8) + 0.0 AS drift FROM drifts"),
    "drift_alerts": with_(
        "telemetry",
        f"""{_POS}, {_MEANS}, {_DRIFT}, rates AS (SELECT session_id, seq, best_similarity >= 0.65 AS hit, avg((best_similarity >= 0.65)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS 999 PRECEDING) AS rate, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS n FROM telemetry)
SELECT session_id, seq, hit, round(rate, 6) + 0.0 AS hit_rate, round(drift, 8) + 0.0 AS drift, n >= 100 AND (rate < 0.7 OR drift > 0.15) AS alert FROM rates JOIN drifts USING (session_id, seq)""",
    ),
    "semantic_inertia": with_(
        "nodes",
        """t AS (SELECT id % 7 AS s, id, v, lag(v) OVER (PARTITION BY id % 7 ORDER BY id) AS b FROM nodes)
SELECT 's' || s AS session_id, count(*) AS pairs, round(avg((list_cosine_similarity(b, v) > 0.05)::INT), 6) + 0.0 AS inertia FROM t WHERE b IS NOT NULL GROUP BY s""",
    ),
    "latency_summary": "SELECT event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) + 0.0 AS stddev, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL GROUP BY event_type",
}
