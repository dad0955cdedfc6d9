"""Packing documents into fixed token windows by best-fit decreasing over a segment tree.

Each task tokenises the texts of its partition and packs them in blocks of at most block_tokens tokens, so that memory is
bounded and nothing is shuffled; padding is lost only in the last few windows of a block. Partitions with less than
TASK_BYTES of text on average are put together first (coalesced, again without a shuffle), so that a block is never small
because the table was written in many small files. Overlong documents are first
cut into full windows, which are sequences of their own; what remains of each is packed with the others: pieces go, longest
first, to the open window with the least capacity that still holds them, found in a segment tree indexed by remaining
capacity.

Cases: a null or empty text has the end token alone; repeated rows are packed once each; an empty table gives an empty
result; extra columns are ignored. A piece is never longer than the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 4_000_000
CACHE_WORDS = 400_000
TASK_BYTES = 8_000_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Token ids as the tokenizer file gives them, from a bounded cache of the ids of single words.

    The vocabulary's pre-tokenizer drops white space and never joins across it, so the ids of a text are those of its
    space-separated words in turn. A word of letters with punctuation behind is two pre-tokens, looked up apart.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # byte-level form: bytes that print stand for themselves
        others = [b for b in range(256) if b not in shown]
        self.letters = {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(others)}}
        self.whole: dict[str, bytes] = {"": b""}
        self.core: dict[str, bytes] = {}
        self.tail: dict[str, bytes] = {"": b""}

    def slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        plain = self.PLAIN.fullmatch(word)
        if not plain:
            return self.slow(word)
        core, tail = plain[1].lower(), plain[2]
        ids = self.core.get(core)
        if ids is None:
            seen = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
            ids = np.array([t.id for t in self.model.tokenize(seen)], "<u4").tobytes()
            if len(core) < 64:
                self.core[core] = ids
        if tail not in self.tail:
            if len(tail) > 8:
                return ids + self.slow(tail)
            self.tail[tail] = self.slow(tail)
        return ids + self.tail[tail]

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        words, whole = text.replace("\n", " ").split(" "), self.whole
        out = []
        for w in words:
            ids = whole.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) < 64:
                    whole[w] = ids
            out.append(ids)
        if len(whole) > CACHE_WORDS:
            self.whole = {"": b""}
        if len(self.core) > CACHE_WORDS:
            self.core = {}
        if len(self.tail) > 10_000:
            self.tail = {"": b""}
        return b"".join(out)


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each length (1 to window)."""
    size = 1
    while size < window + 1:
        size *= 2
    count = [0] * (2 * size)  # open windows by remaining capacity, summed up the tree
    open_bins: list[list[int]] = [[] for _ in range(window + 1)]

    def add(capacity: int, by: int) -> None:
        at = size + capacity
        while at:
            count[at] += by
            at //= 2

    def tightest(least: int) -> int:
        """The smallest capacity >= least with an open window, or -1."""
        at = size + least
        if count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and count[at + 1]:
                at += 1
                while at < size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - size
            at //= 2
        return -1

    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k in np.argsort(-lengths, kind="stable"):
        length = int(lengths[k])
        capacity = tightest(length)
        if capacity < 0:
            bin_, capacity, used = used, window, used + 1
        else:
            bin_ = open_bins[capacity].pop()
            add(capacity, -1)
        bins[k], offsets[k] = bin_, window - capacity
        if capacity > length:
            open_bins[capacity - length].append(bin_)
            add(capacity - length, 1)
    return bins, offsets


_tokenizers: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: (id_col, start, length, doc_tokens, ids, sequence_id, offset); ids are 32-bit little-endian.

    sequence_id is the number of the task in its upper bits and counts up within it.
    """
    vocabulary = vocabulary or vocabulary_path()
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long")).alias("n")).first()["n"] or 0
    docs = docs.coalesce(-(-size // TASK_BYTES) or 1)  # more than there are changes nothing
    out_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = WordTokenizer(vocabulary)
        tokenizer, end = _tokenizers[vocabulary], np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 36
        pieces, held, used = [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal pieces, held, used
            bins, offsets = best_fit_decreasing(np.array([len(p[3]) // 4 for p in pieces], np.int64), window)
            for at in range(0, len(pieces), 2000):
                part = pieces[at : at + 2000]
                columns = [[p[0] for p in part], [p[1] for p in part], [len(p[3]) // 4 for p in part], [p[2] for p in part], [p[3] for p in part], first + used + bins[at : at + 2000], offsets[at : at + 2000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out_schema, strict=True)], schema=out_schema)
            used += int(bins.max()) + 1
            pieces, held = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = tokenizer.ids(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    pieces.append((doc_id, start, total, ids[4 * start : 4 * (start + window)]))
                held += total
                if held >= block_tokens:
                    yield from flush()
        if pieces:
            yield from flush()

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("doc_id", id_col)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
