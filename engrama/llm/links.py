"""From posting lists to classes of linked documents, without emitting all pairs inside a class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stage

#: Lists of up to so many members are compared pair by pair in the second pass, longer ones in blocks.
SHORT_LIST = 32


def link_classes(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], confirm_lists: Callable[[DataFrame], DataFrame], name: str, leaders: int = 2) -> DataFrame | None:
    """Classes (id, component) of the ids in at least one confirmed pair; None without any.

    members (bucket, id): two ids are candidates if they share a bucket. confirm takes distinct pairs (a, b), a < b, and
    returns those that hold. In the first pass every bucket compares its members with one or two leaders, the smallest id and
    one drawn by a hash: as many pairs for each posting at most. The confirmed pairs are joined into classes, and buckets whose
    members are all in one class are done. In the second pass all candidates of different classes are compared, so no link
    between different classes is lost: those of lists of up to SHORT_LIST members as pairs, the others by confirm_lists,
    which takes the open lists (bucket, id, c, n) and returns the pairs of different classes c that hold.
    """
    first = [F.min("id"), F.min_by("id", F.xxhash64("id", "bucket"))][:leaders]
    leads = members.groupBy("bucket").agg(F.array_distinct(F.array(*first)).alias("leads"))
    pairs = members.join(leads, "bucket").select("id", F.explode("leads").alias("lead")).where("id <> lead")
    pairs = stage(pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), f"{name}-pairs")
    links = stage(confirm(pairs), f"{name}-links")
    classes = None if links.isEmpty() else components(links, f"{name}-classes")
    labels = members.withColumn("c", F.col("id"))
    if classes is not None:
        labels = members.join(classes, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    labels = stage(labels, f"{name}-labels")
    open_ = labels.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    labels = stage(labels.join(open_, "bucket"), f"{name}-open")
    short, long_ = labels.where(F.col("n") <= SHORT_LIST), labels.where(F.col("n") > SHORT_LIST)
    other = short.select("bucket", F.col("id").alias("b"), F.col("c").alias("bc"))
    rest = short.join(other, "bucket").where("id < b and c <> bc").select(F.col("id").alias("a"), "b").distinct()
    found = confirm(stage(rest.join(pairs, ["a", "b"], "left_anti"), f"{name}-rest"))
    if not long_.isEmpty():
        found = found.union(confirm_lists(long_))
    found = stage(found, f"{name}-links")
    if found.isEmpty():
        return classes
    return components(found if classes is None else found.union(classes.select(F.col("id").alias("a"), F.col("component").alias("b"))), f"{name}-classes")
