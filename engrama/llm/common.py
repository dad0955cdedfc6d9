"""Shared pieces: skew-proof lookups; connected components and staging come from the core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engrama.operators.components import components
from engrama.session import scratch, shared_dir, shuffles_dropped, stage

__all__ = ["SPACE", "WORD", "attach_groups", "collapsed", "components", "scratch", "shared_dir", "shuffles_dropped", "stage"]

#: ASCII white space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: A group holding at least 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE groups are: the broadcast is bounded.
HOT_SHARE = 1000


def collapsed(text: Column | str) -> Column:
    """Text with every run of white space as one space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """Left-join groups (one row per key, with its row count in size) to rows.

    Groups of total / HOT_SHARE rows or more, of which there can be only HOT_SHARE, are broadcast. Their rows get a
    substitute key made from the column spread, and a mark by which no group is found, so that the sort-merge join for the
    rest stays even. The key is a long or binary column without nulls.
    """
    values = [c for c in groups.columns if c != key]
    hot_from = max(2, -(-total // HOT_SHARE))
    hot = groups.where(F.col(size) >= hot_from).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values])
    cold = groups.where(F.col(size) < hot_from).select(F.col(key).alias("_ck"), *[F.col(c).alias(f"_c_{c}") for c in values])
    away = F.xxhash64(spread)
    if rows.schema[key].dataType.typeName() != "long":
        away = away.cast("string").cast("binary")
    found = rows.join(F.broadcast(hot), rows[key] == F.col("_hk"), "left").withColumn("_jh", F.col("_hk").isNotNull())
    found = found.withColumn("_jk", F.when(F.col("_jh"), away).otherwise(F.col(key)))
    found = found.join(cold.withColumn("_ch", F.lit(False)).hint("merge"), (F.col("_jk") == F.col("_ck")) & (F.col("_jh") == F.col("_ch")), "left")
    merged = [F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in values]
    return found.select(*rows.columns, *merged)
