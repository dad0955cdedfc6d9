"""The corpus pipeline: quality classifier, line dedup, MinHash near-dedup, mixing to target weights, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as docs of the
next. Documents whose lines all repeat earlier ones, and so have no word left, go with their lines. The last stage returns
pieces of documents with their token ids and their places in the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrama.llm.common import stage
from engrama.llm.line_dedup import dedup_lines
from engrama.llm.mixing import mixed, n_words
from engrama.llm.near_dedup import near_duplicates
from engrama.llm.packing import pack
from engrama.llm.quality_classifier import filter_quality, fit


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return filter_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal or similar lines one stays; a document without a word left goes with its lines."""
    out = dedup_lines(docs).where((F.col("n_dropped") == 0) | (n_words() > 0))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, one stays; of repeated rows, too.

    Line dedup leaves of a near copy just the lines in which it differs, by which no copy can be told. So a document that the
    table documents has with other text is compared as it was there as well as it is now: its texts meet under its id.
    """
    now = docs.where("doc_id is not null").select("doc_id", "text")
    same = now.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h")).distinct()
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    whole = whole.join(same.select("_id").distinct(), F.col("doc_id") == F.col("_id"), "left_semi")
    whole = whole.join(same, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")
    gone = near_duplicates(now.unionByName(stage(whole, "near-whole")), shingle=5).where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    often = stage(out.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "near-often")
    if often.isEmpty():
        return out
    once = out.join(often, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(often, "doc_id", "left_anti").unionByName(once).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3, repeating; documents are taken up to three times."""
    return mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near-dedup", near), ("mixing", mix), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
