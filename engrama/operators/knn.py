"""Exact nearest neighbours of a set of queries among all nodes: both are dealt into blocks, and blocks meet in a join.

A block is one row: the ids, sizes and vectors of up to BLOCK rows as bytes. Query blocks and node blocks meet on a grid of
strips, each block of one side in every strip of the other, so that a pair of blocks meets in one task. There it is
multiplied in tiles of a few queries, and the k best of each query over all node blocks seen are kept; only these are
shuffled. A matrix product rounds by position, so it only finds the candidates: their scores are summed anew in one order,
and equal vectors have equal scores. No query passes the driver. What a task holds at once is bounded by bytes, whatever the input, k or the size of a
vector: a batch of pairs (Spark's 64 MB and one pair), a tile of scores and the best hits so far.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from engrama.functions import vectors as V

BLOCK = 2048
#: A block of long vectors has fewer rows, so that they take so many bytes at most.
BLOCK_BYTES = 4 << 20
#: Of a pair of blocks, so many bytes of scores are worked out at once.
TILE_BYTES = 1 << 20
#: Best hits of so many bytes are held in a task, before these are passed on as they are.
HELD_BYTES = 16 << 20
HIT = "qid long, id long, score double"


def _unit(x: np.ndarray) -> np.ndarray:
    square = np.zeros((len(x), 1))
    for c in x.T:
        square[:, 0] += c * c  # in one order, whatever zeros follow
    return np.where(square > V.ZERO_NORM, x / np.sqrt(np.maximum(square, V.ZERO_NORM)), 0.0)


def _int8(x: np.ndarray) -> np.ndarray:
    """What quantize and dequantize leave of each row: codes of eight bits, rounded half away from zero, times the scale."""
    top = np.abs(x).max(1, keepdims=True, initial=0.0)
    scale = np.where(top < 1e-10, 1.0, top / 127.0)
    return np.clip(np.sign(x) * np.floor(np.abs(x) / scale + 0.5), -127, 127) * scale


#: What is done to the vectors of either side, so that an inner product is the score.
METRICS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"cosine": _unit, "dot": lambda x: x, "int8": _int8}


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows as doubles with zeros behind shorter ones, and their sizes."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    for size in np.unique(sizes):
        fits = sizes == size
        out[fits, :size] = column.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return out, sizes


def _blocks(rows: DataFrame, key: str, metric: str, block: int) -> DataFrame:
    """(ids, sizes, vectors) of rows (key, v): one row for up to `block` of them; rows without a key or vector are left out."""
    prepare = METRICS[metric]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            longest = max(1, pc.max(b.column(1).value_lengths()).as_py() or 0)
            rows = max(1, min(block, BLOCK_BYTES // (8 * longest)))
            for lo in range(0, b.num_rows, rows):
                part = b.slice(lo, rows)
                x, sizes = _matrix(part.column(1))
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (ids, sizes, prepare(x))], ["ids", "sizes", "vectors"])

    return rows.select(F.col(key).cast("long").alias("key"), V.doubles("v").alias("v")).where("key is not null and v is not null").mapInArrow(run, "ids binary, sizes binary, vectors binary")


def top_in_batch(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores, its k best (score down, id up): (scores, ids), both of k columns or of all there are."""
    if scores.shape[1] > k:
        bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:].min(1, keepdims=True)
        # ties at the bound are settled by the id: all candidates are ranked, best first, and k stay
        most = int((scores >= bound).sum(1).max())
        at = np.argpartition(-scores, most - 1, axis=1)[:, :most]
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _met(queries: DataFrame, nodes: DataFrame, metric: str, block: int) -> DataFrame:
    """Pairs of blocks (q, n), on a grid of as many strips as there are shuffle partitions, the wider the more nodes there are."""
    spark = queries.sparkSession
    parts, n_queries, n_nodes = int(spark.conf.get("spark.sql.shuffle.partitions")), queries.count(), nodes.count()
    wide = max(1, min(parts, round((parts * n_nodes / max(n_queries, 1)) ** 0.5), -(-n_nodes // block)))
    high = max(1, min(parts // wide, -(-n_queries // block)))
    place = F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # blocks one after another
    q = _blocks(queries, "qid", metric, block).select(F.struct("ids", "sizes", "vectors").alias("q"), F.pmod(place, F.lit(high)).alias("j"))
    n = _blocks(nodes, "id", metric, block).select(F.struct("ids", "sizes", "vectors").alias("n"), F.pmod(place, F.lit(wide)).alias("i"))
    q = q.select("q", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(wide - 1).cast("long"))).alias("i"))
    n = n.select("n", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(high - 1).cast("long"))).alias("j"))
    return n.join(q, ["i", "j"]).select("q.*", F.col("n.ids").alias("n_ids"), F.col("n.sizes").alias("n_sizes"), F.col("n.vectors").alias("n_vectors"))


class _Pair:
    """A pair of blocks: what it scores, TILE_BYTES at a time. Vectors of different sizes score 0."""

    def __init__(self, b: pa.RecordBatch, row: int):
        types = (np.int64, np.int32, float) * 2
        self.q_ids, self.q_sizes, q, self.n_ids, self.n_sizes, n = (np.frombuffer(b.column(c)[row].as_buffer(), t) for c, t in enumerate(types))
        q, n = q.reshape(len(self.q_ids), -1), n.reshape(len(self.n_ids), -1)
        common = min(q.shape[1], n.shape[1])
        self.q, self.n = q[:, :common], n[:, :common]
        self.one_size = (self.q_sizes == self.n_sizes[0]).all() and (self.n_sizes == self.n_sizes[0]).all()
        longest = np.sqrt(np.einsum("ij,ij->i", self.n, self.n).max())
        #: For each query, more than two ways of summing a score can lie apart.
        self.slack = 4 * common * np.finfo(float).eps * longest * np.sqrt(np.einsum("ij,ij->i", self.q, self.q))

    def tiles(self) -> Iterator[tuple[int, np.ndarray]]:
        """(first query, rough scores)."""
        step = max(1, TILE_BYTES // (8 * len(self.n)))
        for lo in range(0, len(self.q), step):
            scores = self.q[lo : lo + step] @ self.n.T
            yield lo, scores if self.one_size else np.where(self.q_sizes[lo : lo + step, None] == self.n_sizes, scores, 0.0)

    def exact(self, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The scores of queries at and nodes to, summed in the order of the dimensions."""
        out = np.zeros(len(at))
        for x, y in zip(self.q.T, self.n.T):
            out += x[at] * y[to]
        return out if self.one_size else np.where(self.q_sizes[at] == self.n_sizes[to], out, 0.0)

    def best(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best nodes of each query: (scores, ids)."""
        k, parts = min(k, len(self.n)), []
        for lo, rough in self.tiles():
            bound = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k:].min(1)
            at, to = np.nonzero(~(rough < (bound - self.slack[lo : lo + len(rough)])[:, None]))
            scores, ids = self.exact(lo + at, to), self.n_ids[to]
            order = np.lexsort((ids, -scores, at))
            pick = order[np.searchsorted(at, np.arange(len(rough)))[:, None] + np.arange(k)]
            parts.append((scores[pick], ids[pick]))
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    def above(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids of queries, ids of nodes, scores) above the threshold."""
        for lo, rough in self.tiles():
            at, to = np.nonzero(~(rough < threshold - self.slack[lo : lo + len(rough), None]))
            scores = self.exact(lo + at, to)
            over = scores > threshold
            yield self.q_ids[lo + at[over]], self.n_ids[to[over]], scores[over]


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked from 1; ties go to the smaller id."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(queries: DataFrame, nodes: DataFrame, k: int, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(qid, id, score, rank) of the k nodes (id, v) most similar to each query (qid, v), all compared exactly.

    Rows without a vector are left out; vectors of different sizes, and zero vectors, score 0.
    """

    def hits(name: bytes, own: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        q_ids, (scores, ids) = np.frombuffer(name, np.int64), own
        step = max(1, TILE_BYTES // (8 * ids.shape[1]))
        for lo in range(0, len(q_ids), step):
            columns = np.repeat(q_ids[lo : lo + step], ids.shape[1]), ids[lo : lo + step].ravel(), scores[lo : lo + step].ravel()
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        size = 0
        for b in batches:
            for row in range(b.num_rows):
                own, name = _Pair(b, row).best(k), b.column(0)[row].as_buffer().to_pybytes()
                if name in held:
                    more = held.pop(name)
                    size -= 2 * more[0].nbytes
                    own = top_in_batch(np.hstack([own[0], more[0]]), np.hstack([own[1], more[1]]), k)
                held[name] = own
                size += 2 * own[0].nbytes
                if size > HELD_BYTES:
                    while held:
                        yield from hits(*held.popitem())
                    size = 0
            b = None  # before the next batch is read
        while held:
            yield from hits(*held.popitem())

    if k < 1:
        return queries.sparkSession.sql("SELECT CAST(NULL AS LONG) qid, CAST(NULL AS LONG) id, CAST(NULL AS DOUBLE) score, 0 rank WHERE false")
    return best(_met(queries, nodes, metric, block).mapInArrow(run, HIT), k)


def similar_above(queries: DataFrame, nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(qid, id, score) of all nodes with a cosine above the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                for columns in _Pair(b, row).above(threshold):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["qid", "id", "score"])

    return _met(queries, nodes, "cosine", block).mapInArrow(run, HIT)


def knn_int8(queries: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The same over quantized vectors: the score is the inner product of the codes, times both scales."""
    return knn(queries, nodes, k, metric="int8")
