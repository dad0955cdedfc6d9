"""The write-ahead log: records (seq, type, size, payload, checksum), replayed up to the first that is damaged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the FNV-1a hash of 64 bits.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def fnv1a(payloads: pa.Array) -> np.ndarray:
    """FNV-1a of each payload, as unsigned numbers; one step for each byte position, over all payloads at once."""
    data = pc.fill_null(payloads.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offs, raw = data.buffers()
    offs = np.frombuffer(offs, np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    size, out = np.diff(offs), np.full(len(data), FNV_OFFSET, np.uint64)
    order = np.argsort(-size, kind="stable")  # longest first: those still open are a prefix
    for k in range(int(size.max()) if len(size) else 0):
        open_ = order[: np.searchsorted(-size[order], -k, "left")]
        out[open_] = (out[open_] ^ raw[offs[open_] + k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return out


def with_fnv1a(records: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds fnv1a, the checksum as 16 hexadecimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = fnv1a(b.column(b.schema.get_field_index(payload)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f"{x:016x}" for x in sums.tolist()])], [*b.schema.names, "fnv1a"])

    fields = ", ".join(f"`{n}` {t}" for n, t in records.dtypes)
    return records.mapInArrow(run, f"{fields}, fnv1a string")


def replay(records: DataFrame, valid: Column, seq: str = "seq") -> DataFrame:
    """The records before the first that isn't valid. The bound is one number, found by a partial aggregation."""
    bad = records.where(~F.coalesce(valid, F.lit(False))).agg(F.min(seq).alias("_bad"))
    return records.join(F.broadcast(bad)).where(F.col("_bad").isNull() | (F.col(seq) < F.col("_bad"))).drop("_bad")


def framed(records: DataFrame, kind: int) -> DataFrame:
    """Records (seq, payload) as the log holds them: type, size in bytes and checksum beside the payload."""
    out = with_fnv1a(records.select("seq", "payload"))
    return out.select("seq", F.lit(kind).alias("type"), F.coalesce(F.octet_length("payload"), F.lit(0)).alias("size"), "payload", F.col("fnv1a").alias("checksum"))


def append(records: DataFrame, path: str, kind: int) -> None:
    """Add records to the log under path; Spark commits them as a whole or not at all."""
    framed(records, kind).write.mode("append").parquet(path)


def recover(log: DataFrame, kind: int) -> DataFrame:
    """(seq, payload) before the first record of another type or size, or whose checksum is not that of its payload."""
    checked = with_fnv1a(log)
    valid = (F.col("type") == kind) & (F.col("size") == F.octet_length("payload")) & (F.col("checksum") == F.col("fnv1a"))
    return replay(checked, valid).select("seq", "payload")


def truncate(log: DataFrame, done: int, path: str) -> None:
    """Write what comes after record `done`, which compaction has taken into the base, as the log under another path."""
    log.where(F.col("seq") > done).write.parquet(path)
