"""The episodic log: append-only events in per-session chains, with tombstones and compaction.

Events are rows (id, session_id, role, text, ts, concept_id, flags); id grows with insertion, flag 1 marks a tombstone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V

from .tree import DEAD, is_dead, numbered

PREVIEW_BYTES = 63
SESSION_BYTES = 35
#: Role codes of the log; what is unknown is "other" when read and user when written.
ROLES = {"user": 0, "system": 1, "concept": 2, "summary": 3, "assistant": 10, "tool": 11, "other": 12}


def _session() -> WindowSpec:
    return W.partitionBy("session_id").orderBy("id")


def role_code(role: str = "role", default: str = "user") -> Column:
    codes = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(codes, F.lower(F.col(role))), F.lit(ROLES[default]))


def role_name(code: str = "role") -> Column:
    names = F.create_map(*[F.lit(x) for name, number in ROLES.items() for x in (number, name)])
    return F.coalesce(F.element_at(names, F.col(code)), F.lit("other"))


def chained(events: DataFrame) -> DataFrame:
    """Adds prev_id: the event before in the same session, null for its first."""
    return events.withColumn("prev_id", F.lag("id").over(_session()))


def append(log: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """log and the rows of new, which get the next ids in the order of a column of distinct values, and their prev_id."""
    last = log.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = numbered(new, order, "id", last + 1).drop(order)
    tails = log.groupBy("session_id").agg(F.max("id").alias("_tail"))
    rows = chained(rows).join(tails, "session_id", "left").withColumn("prev_id", F.coalesce("prev_id", "_tail")).drop("_tail")
    return log.unionByName(rows, allowMissingColumns=True)


def tails(events: DataFrame) -> DataFrame:
    """(session_id, tail_id, n_events) over live events."""
    return events.where(~is_dead()).groupBy("session_id").agg(F.max("id").alias("tail_id"), F.count("*").alias("n_events"))


def history(events: DataFrame, limit: int = 100) -> DataFrame:
    """The newest live events of each session, with age counted from 1; tombstones don't use up the limit, which is 1 at least."""
    limit = max(1, limit)
    newest = W.partitionBy("session_id").orderBy(F.desc("id"))
    return events.where(~is_dead()).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit)


def history_until_gap(events: DataFrame, limit: int = 100) -> DataFrame:
    """History of a compacted log whose prev_id were not rewritten (compat): it ends at the first missing event."""
    newest = W.partitionBy("session_id").orderBy(F.desc("id"))
    ids = events.select(F.col("id").alias("prev_id"), F.lit(1).alias("_there"))
    known = events.join(ids, "prev_id", "left").withColumn("_gap", (F.col("prev_id").isNotNull() & F.col("_there").isNull()).cast("int"))
    broken = F.coalesce(F.sum("_gap").over(newest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    known = known.withColumn("_broken", broken).where("_broken = 0")
    return known.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit).drop("_there", "_gap", "_broken")


def tombstone(events: DataFrame, ids: DataFrame) -> DataFrame:
    """events with the tombstone flag set on those of ids (id); unknown and dead ids change nothing."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(DEAD))
    return events.join(gone, "id", "left").withColumn("flags", F.when(F.col("_gone").isNotNull(), F.col("flags").bitwiseOR(DEAD)).otherwise(F.col("flags"))).drop("_gone")


def drop_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    return events.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def compact(events: DataFrame, relink: bool = True) -> DataFrame:
    """Live events with their ids; relink: prev_id leads to the live event before."""
    live = events.where(~is_dead())
    return chained(live) if relink else live


def previews(events: DataFrame) -> DataFrame:
    """Adds text_preview (63 bytes, whole characters) and blob_size (bytes of the text)."""
    return events.withColumn("text_preview", V.byte_prefix("text", PREVIEW_BYTES)).withColumn("blob_size", F.octet_length("text"))


def blob_offsets(events: DataFrame) -> DataFrame:
    """Adds blob_offset within the session's blob: the bytes of its earlier texts."""
    before = _session().rowsBetween(W.unboundedPreceding, -1)
    return events.withColumn("blob_offset", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))


def prompt_history(events: DataFrame, turns: int = 6) -> DataFrame:
    """The last turns of each session without a user turn at its very end, which is the question itself."""
    newest = W.partitionBy("session_id").orderBy(F.desc("id"))
    ranked = events.where(~is_dead()).withColumn("age", F.row_number().over(newest))
    asked = F.max(F.when((F.col("age") == 1) & (F.col("role") == ROLES["user"]), 1).otherwise(0)).over(W.partitionBy("session_id"))
    return ranked.withColumn("asked", asked).where((F.col("age") > F.col("asked")) & (F.col("age") <= F.col("asked") + turns)).withColumn("age", F.col("age") - F.col("asked")).drop("asked")


def grounded(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with the node that concept_id names, if any."""
    return events.join(nodes.select(F.col("id").alias("concept_id"), F.col("metadata").alias("concept")), "concept_id", "left")


def resolve(ids: DataFrame, *layers: DataFrame) -> DataFrame:
    """The event of each of ids (id), from the first of the layers (base, delta, ...) that has it; ids in none are left out.

    All columns of the events, and layer, counted from 0. Id 0 names no event.
    """
    wanted = ids.where("id <> 0").select("id").distinct()
    each = [rows.join(wanted, "id", "left_semi").withColumn("layer", F.lit(k)) for k, rows in enumerate(layers)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    return both.withColumn("_k", F.row_number().over(W.partitionBy("id").orderBy("layer"))).where("_k = 1").drop("_k")


def sizes(base: DataFrame, delta: DataFrame) -> DataFrame:
    """One row (total, base, delta): events by layer, tombstones included."""
    both = base.select(F.lit(0).alias("d")).union(delta.select(F.lit(1).alias("d")))
    return both.agg(F.count("*").alias("total"), F.count_if(F.col("d") == 0).alias("base"), F.count_if(F.col("d") == 1).alias("delta"))


def has_sessions(asked: DataFrame, events: DataFrame) -> DataFrame:
    """(session_id, has): whether the log has an event of each session asked for."""
    known = events.select("session_id").distinct().withColumn("_has", F.lit(True))
    return asked.select("session_id").distinct().join(known, "session_id", "left").select("session_id", F.coalesce("_has", F.lit(False)).alias("has"))


def full_text(events: DataFrame) -> DataFrame:
    """Adds full_text: the text, or where it is missing or empty the preview (text_preview)."""
    return events.withColumn("full_text", F.when(F.octet_length("text") > 0, F.col("text")).otherwise(F.col("text_preview")))
