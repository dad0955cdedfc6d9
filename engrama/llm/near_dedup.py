"""MinHash near-deduplication by an inverted join over signature coordinates.

A document's set of word shingles has a signature of 18 coordinates; the value of a coordinate is the tuple of four minima
of the set under hashes of its own, so that it says more than one shingle and lists stay short however large the corpus.
Documents with equal sets are one class from the start, known by a 128-bit digest of the set, and one of them stands for it.
Every representative is posted under each of its (coordinate, value) pairs. Two sets of similarity 0.8 agree in a coordinate
with probability 0.41, and in fewer than match (2) with probability 0.001; pairs with 2 collisions or more are retained. To
find them it is enough to merge, for each document, the lists of its 18 - 2 + 1 rarest pairs (prefix); pairs that only it
has need no merging, and the longest list of a document that shares all is skipped. Within lists, members are compared with
leaders and open classes as in link_classes, so that no group is expanded into all its pairs. A candidate's collisions are
counted on the whole signatures, and what is retained is confirmed on the full shingle sets, made anew from the texts. What
is still open in long lists is compared in blocks of bounded size, each pair in the first list that it shares, and only
links leave the block.

Cases: words are runs without ASCII white space, A-Z lower-cased; a text with fewer words than a shingle is one shingle; a
null text or one without words has an empty set, is linked with nothing and stays; equal ids with equal or different texts
are one document each row of which counts on its own: their links meet under that id, n_shingles is each row's own, and the
id is kept if it is the smallest of its class; null ids are linked with nothing and stay. An empty table gives an empty
result; extra columns are ignored. Similarities are exact up to equal 64-bit hashes of different shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow_text as at
from .common import attach_groups, components, scratch, stage
from .links import link_classes

COORDINATES = 18
MINIMA = 4
MATCH = 2
BLOCK_DOCS, BLOCK_BYTES = 1024, 4_000_000
_rng = np.random.default_rng(41)
_MULTIPLY = _rng.integers(0, 2**31, COORDINATES * MINIMA, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, COORDINATES * MINIMA, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted, distinct shingle hashes of each text."""
    word, doc = at.words(at.LOWER[data], offsets)
    cut = np.searchsorted(doc, np.arange(len(offsets)))
    for lo, hi in zip(cut, cut[1:], strict=False):
        yield np.unique(at.grams(word[lo:hi], n))


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate, a 64-bit hash of its number and its minima of 32-bit hashes, drawn by multiplying, adding and mixing."""
    low = np.full(COORDINATES * MINIMA, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(shingles), 4096):
        x = (shingles[k : k + 4096] >> np.uint64(32)).astype(np.uint32)[:, None] * _MULTIPLY + _ADD
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(low, x.min(0), out=low)
    out = np.arange(1, COORDINATES + 1, dtype=np.uint64)
    for part in low.reshape(COORDINATES, MINIMA).T:
        out = at.mix(out * np.uint64(0x9E3779B97F4A7C15) + part)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, digest (binary, null for an empty set), posts: a long for each (coordinate, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in at.chunks(b.column(1)):
                sizes, digests, posts = [], [], []
                for s in shingle_sets(data, offsets, n):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    posts.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(posts, pa.list_(pa.int64()))], ["id", "n_shingles", "digest", "posts"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, digest binary, posts array<long>")


def similar(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose texts (id, text) have 100 * |intersection| >= percent * |union|."""
    sides = pairs.hint("shuffle_merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    sides = sides.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("shuffle_merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for b in batches:
            a_text, b_text = b.column(2), b.column(3)
            keep = np.zeros(b.num_rows, bool)
            at_row = 0
            for lo, hi, data, offsets in at.chunks(b_text):
                for other in shingle_sets(data, offsets, n):
                    mine = a_text[at_row].as_py()
                    if mine != last:  # rows come sorted by a, so its set is made once
                        last = mine
                        _, _, d, o = next(at.chunks(a_text.slice(at_row, 1)))
                        own = next(shingle_sets(d, o, n))
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep[at_row] = 100 * both >= percent * (len(own) + len(other) - both)
                    at_row += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    return sides.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _block_links(table: pa.Table, n: int, percent: int) -> pa.Table:
    """The links between two blocks of one list: rows (bucket, i, j, own block, id, c, merged lists by coordinate, text)."""
    bucket, i, j = (table.column(k)[0].as_py() for k in ("bucket", "i", "j"))
    block, ids, c = (table.column(k).to_numpy() for k in ("block", "id", "c"))
    lists = table.column("lists").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), COORDINATES)
    sets = [s for _, _, data, offsets in at.chunks(table.column("text")) for s in shingle_sets(data, offsets, n)]
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    sizes = np.array([len(s) for s in sets])
    todo = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 64]
        mine, theirs = lists[rows][:, None, :], lists[right][None, :, :]
        first = np.where((mine == theirs) & (mine != 0), mine, np.iinfo(np.int64).max).min(2)
        small, large = np.minimum(sizes[rows][:, None], sizes[right]), np.maximum(sizes[rows][:, None], sizes[right])
        todo[lo : lo + 64] = (first == bucket) & (c[rows][:, None] != c[right]) & (100 * small >= percent * large)
        if i == j:
            todo[lo : lo + 64] &= ids[rows][:, None] < ids[right]
    left, right, todo = left[todo.any(1)], right[todo.any(0)], todo[np.ix_(todo.any(1), todo.any(0))]
    both = np.zeros(todo.shape, np.float32)
    if todo.any():  # count common shingles as a product of membership matrices, some columns at a time
        words = np.concatenate([sets[k] for k in left])
        theirs = np.concatenate([sets[k] for k in right])
        shared = np.intersect1d(words, theirs)
        for lo in range(0, len(shared), 4096):
            some = shared[lo : lo + 4096]
            parts = []
            for side in (left, right):
                m = np.zeros((len(side), len(some)), np.float32)
                for r, k in enumerate(side):
                    at_ = np.searchsorted(some, sets[k])
                    ok = at_ < len(some)
                    m[r, at_[ok][some[at_[ok]] == sets[k][ok]]] = 1
                parts.append(m)
            both += parts[0] @ parts[1].T
    hit = todo & (100 * both >= percent * (sizes[left][:, None] + sizes[right] - both))
    a, b = ids[left[np.nonzero(hit)[0]]], ids[right[np.nonzero(hit)[1]]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def similar_in_lists(open_: DataFrame, merged: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (a, b) between members of different classes c of the lists open_ (bucket, id, c, n).

    A list is dealt into blocks of at most about BLOCK_DOCS documents and BLOCK_BYTES bytes, and each pair of blocks is one
    group, so no group is unbounded; merged (id, lists) has the lists that a document is merged in, 0 for others.
    """
    rows = open_.join(merged, "id").join(texts, "id")
    sizes = open_.join(texts.select("id", F.octet_length("text").alias("bytes")), "id").groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("bytes").alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = rows.join(sizes.select("bucket", blocks.alias("blocks")), "bucket")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "c", "lists", "text")
    return rows.groupBy("bucket", "i", "j").applyInArrow(lambda t: _block_links(t, n, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, match: int = MATCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, kept for each row of docs. docs is read again for the texts of candidates."""
    with scratch(docs.sparkSession):
        return stage(_near_duplicates(docs, shingle, percent, match, id_col, text_col), "near-duplicates", keep=True)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, match: int, id_col: str, text_col: str) -> DataFrame:
    rows = stage(signatures(docs, shingle, id_col, text_col), "near-signatures")
    total = rows.count()
    real = rows.where("digest is not null and id is not null")
    groups = stage(real.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "near-groups")
    # one row of posts for each representative; of an id with several texts all sets are posted
    reps = real.join(groups.select(F.col("digest").alias("_d"), "rep").hint("shuffle_merge"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep"))).select("digest", "id", "posts").dropDuplicates(["digest"])
    posts = reps.select("id", "digest", F.posexplode("posts").alias("coordinate", "bucket"))
    lists = posts.groupBy("bucket").agg(F.count("*").alias("df")).where("df > 1")
    shared = posts.join(lists.hint("shuffle_merge"), "bucket")
    prefix = F.col("k") <= F.col("n") - match + 1  # of n shared lists; the pairs that only this one has come before them
    own = W.partitionBy("id", "digest")
    shared = shared.withColumn("k", F.row_number().over(own.orderBy("df", "bucket"))).withColumn("n", F.count("*").over(own)).where(prefix)
    merged = stage(shared.select("bucket", "id", "digest", "coordinate"), "near-postings")
    members = merged.select("bucket", "id").distinct()
    signs = stage(reps.join(members.select("id").distinct(), "id", "left_semi").select("id", "posts"), "near-candidates")
    candidates = signs.select(F.col("id").alias("_id")).distinct().hint("shuffle_merge")  # the same plan at every size
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(candidates, F.col("id") == F.col("_id"), "left_semi")
    texts = stage(texts.groupBy("id", F.xxhash64("text")).agg(F.min("text").alias("text")).select("id", "text"), "near-texts")

    def confirm(pairs: DataFrame) -> DataFrame:
        left, right = signs.select(F.col("id").alias("a"), F.col("posts").alias("pa")), signs.select(F.col("id").alias("b"), F.col("posts").alias("pb"))
        retained = pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("pa", "pb")) >= match).select("a", "b").distinct()
        return similar(stage(retained, "near-retained"), texts, shingle, percent).distinct()

    def confirm_lists(open_: DataFrame) -> DataFrame:
        needed = open_.select("id").distinct()
        slots = F.transform(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long")))
        own = merged.join(needed, "id", "left_semi").groupBy("id", "digest").agg(F.map_from_entries(F.collect_set(F.struct("coordinate", "bucket"))).alias("m"))
        return similar_in_lists(open_, own.select("id", slots.alias("lists")), texts, shingle, percent)

    classes = link_classes(members, confirm, confirm_lists, "near")
    # ids with several texts link the representatives of their sets
    several = real.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    found = attach_groups(rows, groups.select("digest", F.col("rep"), "n"), "digest", "n", total, "id")
    if not several.isEmpty():
        more = found.where("rep is not null and id is not null").join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        links = classes.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more) if classes is not None else more
        classes = components(links, "near-classes")
    found = found.withColumn("rep", F.coalesce("rep", "id"))
    if classes is not None:
        found = found.join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    else:
        found = found.withColumn("component", F.lit(None).cast("long"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
