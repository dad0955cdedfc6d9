"""WARC archives written with an index, and read back by coalesced byte ranges of the records selected.

Writing: each task writes one .warc.gz of gzip members, one for each record, and returns for each record its file, offset,
length, URL and digest; these rows, written as Parquet before anything is read, are the index. A task that runs twice
writes a second file that no index row names. Reading: index rows are selected first (by any of its columns), dealt out by
file and stretch, sorted by offset, merged into ranges where the gap is small, and each range is read with one call.
Files are opened through pyarrow's file systems, so that the folder may be on any store that those reach.

Cases: a null payload is an empty one; of records with equal payloads of at least min_bytes bytes that with the smallest
page id is a response and the others are revisits, which hold headers only; smaller ones are all responses; rows with equal
page ids and payloads are each written (the first stays a response, as its id is the one that stays); null URLs are
written as about:blank; a null page id is written as an empty one, counts as larger than any and reads back as null; an
empty table gives an empty archive and result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach_groups, shared_dir, stage

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string"
STRETCH = 8 << 20
MOST_TASKS = 20_000
GAP = 64 << 10


def _filesystem(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):  # file:/x and file:///x
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record(kind: str, page_id, url: str, date: str, digest: str, payload: bytes, size: int, refers_to) -> bytes:
    """One gzip member with one record; a revisit has no block, and the size of its payload in an extension header."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def _clean(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, r"[\r\n]", ""), F.lit("about:blank"))


def write(pages: DataFrame, folder: str, min_bytes: int = 100, date: datetime | None = None) -> DataFrame:
    """Write pages (page_id, url, html) to archives in folder; returns the index, which is also written to folder/index."""
    spark = pages.sparkSession
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), _clean(F.col("url")).alias("url"), payload.alias("payload"))
    digests = stage(rows.select("page_id", F.unhex(F.sha2("payload", 256)).alias("digest"), F.octet_length("payload").alias("size")), "warc-digests")
    large = digests.where(F.col("size") >= min_bytes)
    groups = large.groupBy("digest").agg(F.min("page_id").alias("keep_id"), F.count("*").alias("n")).where("n > 1")
    plan = attach_groups(large, groups, "digest", "n", digests.count(), "page_id").where("keep_id is not null and not page_id <=> keep_id")
    plan = plan.select(F.col("page_id").alias("_pid"), F.col("digest").alias("_d"), "keep_id").distinct()
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    rows = rows.join(plan, F.col("page_id").eqNullSafe(F.col("_pid")) & (F.col("digest") == F.col("_d")), "left")
    rows = rows.select("page_id", "url", F.lower(F.hex("digest")).alias("digest"), F.octet_length("payload").alias("size"), F.when(F.col("keep_id").isNull(), F.col("payload")).alias("payload"), "keep_id")
    stamp, run = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ"), uuid.uuid4().hex[:8]
    schema = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, context = None, 0, TaskContext.get()
        try:
            for b in batches:
                index = []
                for r in b.to_pylist():
                    if out is None:
                        store, place = _filesystem(folder)
                        store.create_dir(place, recursive=True)
                        name = f"{run}-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
                        out = store.open_output_stream(f"{place}/{name}", compression=None)
                    kind = "response" if r["keep_id"] is None else "revisit"
                    data = record(kind, r["page_id"], r["url"], stamp, r["digest"], r["payload"] or b"", r["size"], r["keep_id"])
                    out.write(data)
                    index.append((r["page_id"], f"{folder}/{name}", at, len(data), r["url"], r["digest"], kind))
                    at += len(data)
                if index:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), schema, strict=True)], schema=schema)
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(task, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def merged_ranges(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = STRETCH) -> list[tuple[int, int, int, int]]:
    """For sorted records: (first record, end record, start byte, end byte) of the reads."""
    out: list[tuple[int, int, int, int]] = []
    for k, (at, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out and at - out[-1][3] <= gap and at + n - out[-1][2] <= most:
            out[-1] = (out[-1][0], k + 1, out[-1][2], max(out[-1][3], at + n))
        else:
            out.append((k, k + 1, at, at + n))
    return out


RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read(selected: DataFrame, gap: int = GAP) -> DataFrame:
    """The records of the index rows selected: RECORDS. Of a response, size and digest are those of the payload read."""
    dealt = selected.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    # by what is to be read, not by the size of the index rows
    tasks = min(MOST_TASKS, 1 + (selected.agg(F.sum("length")).first()[0] or 0) // STRETCH)
    dealt = dealt.repartition(int(tasks), "file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        name, source = None, None
        fields = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
        for b in batches:
            files, offsets, lengths = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            cut = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
            for lo, hi in zip(cut, cut[1:], strict=False):
                if lo == hi:
                    continue
                if files[lo] != name:
                    name = files[lo]
                    store, place = _filesystem(name)
                    source = store.open_input_file(place)
                for first, end, start, stop in merged_ranges(offsets[lo:hi], lengths[lo:hi], gap):
                    data, rows = source.read_at(stop - start, start), []
                    for k in range(lo + first, lo + end):
                        head, block = parse(data[offsets[k] - start : offsets[k] - start + lengths[k]])
                        revisit, digest = head["WARC-Type"] == "revisit", head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and sha256(block).hexdigest() != digest:
                            raise ValueError(f"{name} at {offsets[k]}: the payload doesn't have its digest")
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"], None if revisit else block, int(head["X-Payload-Length"]) if revisit else len(block), digest, number(head["WARC-Refers-To"]) if revisit else None))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    return dealt.mapInArrow(task, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), shared_dir(spark, "warc"))
    return read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
k AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> keep_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> keep_id THEN keep_id END AS refers_to
FROM k
"""
