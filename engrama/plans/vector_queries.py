"""Vector functions and exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.functions import vectors as V
from engrama.operators import access
from engrama.operators.knn import knn, knn_int8

from . import fixtures as fx
from .fixtures import with_


def r6(c) -> F.Column:
    return F.round(c, 6)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir)
    return n.select("id", F.col("v").alias("a")).join(n.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id")


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", r6(V.cosine("a", "b")).alias("cosine"), r6(V.dot("a", "b")).alias("dot"))


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir), 5).select("qid", "id", r6("score").alias("score"), "rank")


def knn_prefilter_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.prefiltered_knn(fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir), ["layer_0", "layer_2"], 5).select("qid", "id", r6("score").alias("score"), "rank")


def knn_postfilter_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.postfiltered_knn(fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir), ["layer_0", "layer_2"], 5).select("qid", "id", r6("score").alias("score"), "rank")


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.nodes(spark, sf_dir).select("id", "v", V.quantize("v").alias("c")).select("id", "v", "c.q", "c.scale")


def int8_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _coded(spark, sf_dir)
    return q.select("id", F.round("scale", 9).alias("scale"), V.total("q").cast("long").alias("q_sum"), V.total(F.transform("q", F.abs)).cast("long").alias("q_abs_sum"), F.array_max("q").cast("long").alias("q_max"))


def int8_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_int8(fx.asked(spark, sf_dir), fx.nodes(spark, sf_dir), 5).select("qid", "id", r6("score").alias("score"), "rank")


def int8_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.zip_with("v", V.dequantize("q", "scale"), lambda x, y: F.abs(x - y))
    return _coded(spark, sf_dir).select("id", r6(F.array_max(gap)).alias("worst"), (F.array_max(gap) <= F.col("scale")).alias("within_scale"))


def int8_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _coded(spark, sf_dir)
    other = c.select((F.col("id") - 1).alias("id"), F.col("q").alias("q2"), F.col("scale").alias("scale2"))
    return c.join(other, "id").select("id", V.int_dot("q", "q2").cast("long").alias("raw"), r6(V.dequantized_dot("q", "scale", "q2", "scale2")).alias("score"))


def node_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir).select(F.size("v").alias("dim"), F.octet_length("metadata").alias("meta"), "layer_id")
    n = n.select("layer_id", V.node_stride(F.col("dim"), F.col("meta"), 4).alias("f"), V.node_stride(F.col("dim"), F.col("meta"), 1).alias("q"))
    return n.groupBy("layer_id").agg(F.count("*").alias("nodes"), F.sum("f").alias("bytes_fp32"), F.sum("q").alias("bytes_int8"))


def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.asked(spark, sf_dir).select("qid", V.normalised("v").alias("u"))
    return q.select("qid", F.posexplode("u").alias("pos", "x")).select("qid", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


def softmax_jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("id", V.softmax("a").alias("p"), V.softmax("b").alias("q"))
    return p.select("id", F.round(V.kl_divergence("p", "q"), 8).alias("kl"), F.round(V.js_divergence("p", "q"), 8).alias("jsd"))


def zero_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fx.nodes(spark, sf_dir).select("id", V.padded("v", 768).alias("p"), "v")
    return n.select("id", F.size("p").cast("long").alias("size"), r6(V.total("p")).alias("total"), F.size("v").cast("long").alias("size_before"))


def vector_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.preview("v")
    return fx.nodes(spark, sf_dir).select("id", *[r6(F.element_at(p, k + 1)).alias(f"p{k}") for k in range(3)])


_SCORED = "scored AS (SELECT qid, id, list_cosine_similarity(qv, v) AS s, layer_id FROM asked, nodes)"
_RANKED = "ranked AS (SELECT qid, id, s, layer_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id)::INT AS rank FROM {0})"
_CODES = """coded AS (SELECT id, v, CASE WHEN top < 1e-10 THEN 1.0 ELSE top / 127.0 END AS scale FROM (SELECT id, v, list_max(list_transform(v, lambda x: abs(x))) AS top FROM nodes)),
quantized AS (SELECT id, v, scale, list_transform(v, lambda x: least(127.0, greatest(-127.0, round(x / scale)))::INT) AS q FROM coded)"""
_SOFT = """soft AS (SELECT id, list_transform(e, lambda x: x / (list_sum(e) + 1e-12)) AS p FROM (SELECT id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM nodes)),
pairs AS (SELECT a.id, a.p, b.p AS q, list_transform(list_zip(a.p, b.p), lambda z: (z[1] + z[2]) * 0.5) AS m FROM soft a JOIN soft b ON b.id = a.id + 1)"""


def _kl(p: str, q: str) -> str:
    return f"list_sum(list_transform(list_zip({p}, {q}), lambda z: z[1] * ln((z[1] + 1e-12) / (z[2] + 1e-12))))"


QUERIES = {f.__name__: f for f in (knn_topk, cosine_pairs, knn_prefilter_layer, knn_postfilter_layer, int8_quantize, int8_knn, int8_error, int8_dot, node_stride, l2_normalise, softmax_jsd, zero_pad, vector_preview)}
SQL = {
    "cosine_pairs": with_("nodes", "SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS cosine, round(list_inner_product(a.v, b.v), 6) + 0.0 AS dot FROM nodes a JOIN nodes b ON b.id = a.id + 1"),
    "knn_topk": with_("nodes asked", f"{_SCORED}, {_RANKED.format('scored')} SELECT qid, id, round(s, 6) + 0.0 AS score, rank FROM ranked WHERE rank <= 5"),
    "knn_prefilter_layer": with_("nodes asked", f"{_SCORED}, seen AS (SELECT * FROM scored WHERE layer_id IN ('layer_0', 'layer_2')), {_RANKED.format('seen')} SELECT qid, id, round(s, 6) + 0.0 AS score, rank FROM ranked WHERE rank <= 5"),
    "knn_postfilter_layer": with_("nodes asked", f"{_SCORED}, {_RANKED.format('scored')} SELECT qid, id, round(s, 6) + 0.0 AS score, rank FROM ranked WHERE rank <= 5 AND layer_id IN ('layer_0', 'layer_2')"),
    "int8_quantize": with_("nodes", f"{_CODES} SELECT id, round(scale, 9) + 0.0 AS scale, list_sum(q)::BIGINT AS q_sum, list_sum(list_transform(q, lambda x: abs(x)))::BIGINT AS q_abs_sum, list_max(q)::BIGINT AS q_max FROM quantized"),
    "int8_knn": with_(
        "nodes asked",
        f"""{_CODES}, qc AS (SELECT qid, qv, CASE WHEN top < 1e-10 THEN 1.0 ELSE top / 127.0 END AS scale FROM (SELECT qid, qv, list_max(list_transform(qv, lambda x: abs(x))) AS top FROM asked)),
qq AS (SELECT qid, scale AS qs, list_transform(qv, lambda x: least(127.0, greatest(-127.0, round(x / scale)))::DOUBLE) AS qc FROM qc),
scored AS (SELECT qid, id, list_inner_product(qc, q::DOUBLE[]) * qs * scale AS s, '' AS layer_id FROM qq, quantized), {_RANKED.format('scored')}
SELECT qid, id, round(s, 6) + 0.0 AS score, rank FROM ranked WHERE rank <= 5""",
    ),
    "int8_error": with_("nodes", f"{_CODES}, gaps AS (SELECT id, scale, list_max(list_transform(list_zip(v, q), lambda z: abs(z[1] - z[2] * scale))) AS gap FROM quantized) SELECT id, round(gap, 6) + 0.0 AS worst, gap <= scale AS within_scale FROM gaps"),
    "int8_dot": with_("nodes", f"{_CODES} SELECT a.id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS raw, round(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) * a.scale * b.scale, 6) + 0.0 AS score FROM quantized a JOIN quantized b ON b.id = a.id + 1"),
    "node_stride": with_("nodes", "SELECT layer_id, count(*) AS nodes, sum((64 + len(v) * 4 + octet_length(encode(metadata)) + 63) // 64 * 64)::BIGINT AS bytes_fp32, sum((64 + len(v) + octet_length(encode(metadata)) + 63) // 64 * 64)::BIGINT AS bytes_int8 FROM nodes GROUP BY layer_id"),
    "l2_normalise": with_("asked", "SELECT qid, (generate_subscripts(qv, 1) - 1)::BIGINT AS pos, round(unnest(qv) / (sqrt(list_inner_product(qv, qv)) + 1e-12), 6) + 0.0 AS x FROM asked"),
    "softmax_jsd": with_("nodes", f"{_SOFT} SELECT id, round({_kl('p', 'q')}, 8) + 0.0 AS kl, round(0.5 * {_kl('p', 'm')} + 0.5 * {_kl('q', 'm')}, 8) + 0.0 AS jsd FROM pairs"),
    "zero_pad": with_("nodes", "SELECT id, 768::BIGINT AS size, round(list_sum(v), 6) + 0.0 AS total, len(v)::BIGINT AS size_before FROM nodes"),
    "vector_preview": with_("nodes", "SELECT id, round(v[1], 6) + 0.0 AS p0, round(v[2], 6) + 0.0 AS p1, round(v[3], 6) + 0.0 AS p2 FROM nodes"),
}
