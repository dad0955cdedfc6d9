"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrama.session import stage


def components(edges: DataFrame, name: str = "components", most_rounds: int = 40) -> DataFrame:
    """Distributed union-find: for edges (a, b) of long ids, rows (id, component), component the smallest id reachable.

    Alternates large-star and small-star contraction, each a join and a partial aggregation, until the edges form stars:
    no id has two smaller ends, or both a smaller and a larger one. The number of rounds grows with the logarithm of the
    longest path. Nothing is collected. Ids without an edge are not returned.
    """
    now = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v")
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = stage(small.select("v", "u"), name)
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        if ends.where("low > 1 or low = 1 and top = 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
