"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every source has a target of tokens (here: words). Whole repeats of a source cover target // size; for the rest, documents
are taken in the order of a hash of their id, up to a threshold. The threshold is found without sorting: sum the sizes by
source and hash bucket, find the bucket in which the running sum passes the budget, and refine that bucket alone, level by
level, until one hash value is left; the documents are then filtered by hash < threshold. Thresholds are nested: a larger
budget takes a superset.

Cases: a null text has size 0; a null source is a source of its own, last in order; rows with equal ids share a hash and
are taken together; documents of size 0 have taken = 0; an empty table gives an empty result; extra columns are ignored.
Sources are aggregated before anything global; the ranking of sources sees one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, stage

HASH_BITS = 52
LEVELS = (12, 12, 12, 16)


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash52(col: str) -> Column:
    """The first 52 bits of an MD5 of the id: the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_key(col: str = "source") -> Column:
    """Sources in code-point order with null last, as a string that is never null."""
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("\x01"), F.col(col)))


def targets(sizes: DataFrame, weight: Column, share: float, most: int) -> DataFrame:
    """For (skey, source_size): target, with sources over most times their size held there and the excess reshared."""
    ranked = sizes.withColumn("weight", weight)
    cap = F.lit(most) * F.col("source_size")
    ranked = ranked.withColumn("ratio", cap.cast("double") / F.col("weight"))
    everything = W.partitionBy()
    before = W.orderBy("ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.select(
        "*",
        F.row_number().over(W.orderBy("ratio", "skey")).alias("pos"),
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("weight_left"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("capped"),
    ).withColumn("level", (F.col("budget") - F.col("capped").cast("double")) / F.col("weight_left"))
    settled = F.when(F.col("level") <= F.col("ratio"), F.col("pos"))
    ranked = ranked.withColumn("_at", F.min(settled).over(everything))
    ranked = ranked.withColumn("lambda", F.max(F.when(F.col("pos") == F.col("_at"), F.col("level"))).over(everything))
    level = F.coalesce(F.col("lambda") * F.col("weight"), cap.cast("double"))
    return ranked.select("skey", "source_size", F.least(cap.cast("double"), level).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(id_col, skey, size, source_size, target, copies, taken), one row for each row of docs.

    Sources in code-point order have the weights given, repeating, and share `share` of all words; no source takes more
    than `most` times its size.
    """
    rows = stage(docs.select(F.col(id_col), source_key(source_col).alias("skey"), n_words(text_col).alias("size"), hash52(id_col).alias("h")), "mix-sizes")
    sizes = rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(W.orderBy("skey")) - 1) % len(weights) + 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), place)
    plan = targets(sizes, weight, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.col("target") - (F.col("whole") * F.col("source_size")).cast("double"))
    plan = stage(plan, "mix-targets")

    # bound: per source, the prefix of hash bits in which the budget runs out, and the size taken below it
    bound, shift = plan.select("skey", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), HASH_BITS
    for bits in LEVELS:
        inside = rows if shift == HASH_BITS else rows.join(bound.select("skey", F.col("prefix").alias("_p")), "skey").where(F.shiftright("h", shift) == F.col("_p"))
        shift -= bits
        hist = inside.groupBy("skey", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("tokens")).where("tokens > 0")
        hist = hist.join(bound.drop("prefix"), "skey")
        hist = hist.withColumn("upto", F.col("below") + F.sum("tokens").over(W.partitionBy("skey").orderBy("bucket")))
        passed = hist.where(F.col("upto") > F.col("rest")).groupBy("skey").agg(F.min_by(F.struct("rest", F.col("bucket").alias("prefix"), (F.col("upto") - F.col("tokens")).alias("below"), "upto"), "bucket").alias("b"))
        bound = stage(passed.select("skey", "b.*"), "mix-bound").drop("upto") if shift else stage(passed.select("skey", "b.*"), "mix-bound")
    nearer = (F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("below"))
    limit = bound.select("skey", (F.col("prefix") + nearer.cast("long")).alias("limit"))
    plan = stage(plan.join(limit, "skey", "left").select("skey", "source_size", "target", "whole", F.coalesce("limit", F.lit(0)).alias("limit")), "mix-plan")
    copies = F.col("whole") + (F.col("h") < F.col("limit")).cast("long")
    return rows.join(plan, "skey").withColumn("copies", copies).select(id_col, "skey", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs that are taken, each as often as it is taken; documents without a word go."""
    id_col, source_col, text_col = options.get("id_col", "doc_id"), options.get("source_col", "source"), options.get("text_col", "text")
    plan = mix(docs, **options)
    # copies depends on the source and the hash of the id alone, so one row for each (id, source) decides for all its rows
    plan = plan.where("taken > 0").select(F.col(id_col).alias("__id"), F.col("skey").alias("__skey"), "copies").distinct()
    taken = docs.withColumn("__words", n_words(text_col)).where("__words > 0").drop("__words").withColumn("__sk", source_key(source_col))
    taken = taken.join(plan.withColumnRenamed("copies", "__copies"), F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sk") == F.col("__skey")))
    return taken.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select(*docs.columns)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
q AS (SELECT *, (3 * source_size)::DOUBLE / weight AS ratio FROM r),
c AS (SELECT *, row_number() OVER o AS pos, sum(source_size) OVER () AS total,
             sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left, coalesce(sum(3 * source_size) OVER b, 0) AS capped
      FROM q WINDOW o AS (ORDER BY ratio, source NULLS LAST),
                    b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total::DOUBLE - capped::DOUBLE) / weight_left::DOUBLE AS level FROM c),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, (SELECT arg_min(level, pos) FROM l WHERE level <= ratio) * weight) AS target FROM l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS tokens FROM d GROUP BY source, h),
u AS (SELECT g.source, g.h, g.tokens, w.target - (w.whole * w.source_size)::DOUBLE AS rest,
             sum(g.tokens) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
      FROM g JOIN w ON g.source IS NOT DISTINCT FROM w.source WHERE g.tokens > 0),
x AS (SELECT source, arg_min(h + CASE WHEN upto - rest < rest - (upto - tokens) THEN 1 ELSE 0 END, h) AS lim FROM u WHERE upto > rest GROUP BY source)
SELECT d.doc_id, d.size, w.source_size, w.target,
       (d.size * (w.whole + CASE WHEN d.h < coalesce(x.lim, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
