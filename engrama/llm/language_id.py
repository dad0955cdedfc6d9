"""Language identification by prediction by partial matching (PPM, escape method C, no exclusions).

For every language a tree of byte contexts of order 0 to 3 is counted over a sample of its texts and then frozen. A byte is
coded in the longest known context of its language: with probability n / (N + d) if it was seen there n times among N
symbols of d kinds, else by an escape of probability d / (N + d) and the next shorter context, in the end uniformly over 256
bytes. The exact code length of a whole text under each tree is the sum over its bytes, and the shortest wins; the score is
the posterior probability of the winner with equal priors.

Counting runs in Spark (windows of four bytes by language, summed by a shuffle) over a sample of about docs_per_language (800)
documents of each language, taken by a hash of their id, whole texts. All languages are learned. Tasks unfold trees into
tables over the byte values seen, so that a code length is a lookup. Languages are dealt into groups whose tables stay within
table_bytes (256 MB); a group's trees come to the driver and go out to one pass over the texts, which carries the shortest
length so far from pass to pass, so memory does not grow with the number of languages; few languages are one group.

Cases: text is lower-cased; null texts and texts without a letter are `und` with score 0; without anything to learn from
all are `und`; null languages are not learned; ties go to the first language in code-point order; repeated rows are each
scored; extra columns are ignored. Texts begin as after spaces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import chunks
from .common import stage

DOCS_PER_LANGUAGE = 800
TABLE_BYTES = 256 << 20
ORDER = 3


def _windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the code of it and the three before it in its text, oldest first; spaces stand before a text."""
    padded = [data.astype(np.uint32)]
    for back in range(1, ORDER + 1):
        shifted = np.full(len(data), 0x20, np.uint32)
        shifted[back:] = data[:-back] if len(data) >= back else data[:0]
        for k in range(back):  # the first bytes of each text
            at = offsets[:-1] + k
            shifted[at[(at < offsets[1:])]] = 0x20
        padded.append(shifted)
    return (padded[3] << 24) | (padded[2] << 16) | (padded[1] << 8) | padded[0]


@dataclass
class Trees:
    """langs; for each, the codes of the four-byte windows seen and how often."""

    langs: list[str]
    codes: list[np.ndarray]
    times: list[np.ndarray]

    def unfold(self) -> Tables:
        return Tables(self)


class Tables:
    """Code lengths in bits, as float32: shallow[context of two, byte, language]; deep[row of the context of three, byte, language]."""

    def __init__(self, trees: Trees):
        seen = np.unique(np.concatenate([*(np.unique(c & np.uint32(0xFF)) for c in trees.codes), [0x20]]))
        self.kind = np.zeros(256, np.int64)  # 0: never seen
        self.kind[seen.astype(int)] = np.arange(1, len(seen) + 1)
        a, langs = len(seen) + 1, len(trees.langs)
        self.a, contexts = a, []
        split = []
        for codes in trees.codes:
            parts = [self.kind[(codes >> np.uint32(s)) & np.uint32(0xFF)] for s in (24, 16, 8, 0)]
            split.append(parts)
            contexts.append(np.unique((parts[0] * a + parts[1]) * a + parts[2]))
        known = np.unique(np.concatenate(contexts))
        self.row = np.zeros(a**3, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.shallow = np.empty((a * a, a, langs), np.float32)
        self.deep = np.empty((len(known) + 1, a, langs), np.float32)
        self.deep[0] = 0
        pair = known % (a * a)  # the context of two inside that of three
        for k, ((c3, c2, c1, s), times) in enumerate(zip(split, trees.times, strict=True)):
            below = np.full((1, a), 8.0)
            for context, n in ((np.zeros_like(s), 1), (c1, a), (c2 * a + c1, a * a)):
                count = np.bincount(context * a + s, times, n * a).reshape(n, a)
                below = self._code(count, below[np.arange(n) % len(below)])  # a context ends in the next shorter one
            self.shallow[:, :, k] = below
            count = np.bincount((self.row[(c3 * a + c2) * a + c1] - 1) * a + s, times, len(known) * a).reshape(-1, a)
            self.deep[1:, :, k] = self._code(count, below[pair])
        self.langs = trees.langs

    @staticmethod
    def _code(count: np.ndarray, below: np.ndarray) -> np.ndarray:
        total, kinds = count.sum(-1, keepdims=True), (count > 0).sum(-1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            direct = np.log2((total + kinds) / count)
            escape = np.where(total > 0, np.log2((total + kinds) / kinds), 0.0)
        return np.where(count > 0, direct, escape + below)

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The code length of each text under each language."""
        codes = _windows(data, offsets)
        c3, c2, c1, s = (self.kind[(codes >> np.uint32(k)) & np.uint32(0xFF)] for k in (24, 16, 8, 0))
        pair = c2 * self.a + c1
        row = self.row[c3 * (self.a * self.a) + pair]
        each = self.deep[row, s]
        new = np.flatnonzero(row == 0)
        each[new] = self.shallow[pair[new], s[new]]
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            out[full] = np.add.reduceat(each, offsets[full], axis=0, dtype=np.float64)
        return out


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def grouped(contexts: dict[str, int], table_bytes: int) -> list[list[str]]:
    """Languages, in order, in groups whose tables have at most table_bytes; contexts of three bytes by language."""
    groups: list[list[str]] = []
    held = 0
    for lang in sorted(contexts):
        if not groups or (held + contexts[lang]) * (len(groups[-1]) + 1) * 257 * 4 > table_bytes:
            groups.append([])
            held = 0
        groups[-1].append(lang)
        held += contexts[lang]
    return groups


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, table_bytes: int = TABLE_BYTES, id_col: str = "doc_id") -> Iterator[Trees]:
    """Count the trees of all languages of docs (id_col, text, lang), and give them group by group."""
    docs = docs.where("lang is not null and text is not null")
    many = docs.groupBy("lang").count().select(F.col("lang").alias("_l"), (F.lit(float(docs_per_language)) / F.col("count") * float(1 << 62)).alias("_share"))
    sample = docs.select(id_col, "text", "lang").join(many, F.col("lang") == F.col("_l"))  # a row a language
    sample = sample.where(F.shiftrightunsigned(F.xxhash64(id_col, F.lit("language")), 2) < F.col("_share")).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column(1).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                for _, _, data, offsets in chunks(_lowered(b.column(0).filter(pc.equal(langs.indices, k)))):
                    codes, times = np.unique(_windows(data, offsets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(times.astype(np.int64))], ["lang", "code", "n"])

    counts = stage(sample.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")), "language-windows")
    contexts = counts.select("lang", F.shiftrightunsigned("code", 8).alias("context")).distinct().groupBy("lang").count()
    for langs in grouped({r["lang"]: r["count"] for r in contexts.collect()}, table_bytes):
        rows: pd.DataFrame = counts.where(F.col("lang").isin(langs)).toPandas()
        parts = [rows[rows["lang"] == lang].sort_values("code") for lang in langs]
        yield Trees(langs, [p["code"].to_numpy().astype(np.uint32) for p in parts], [p["n"].to_numpy().astype(float) for p in parts])


def _compared(docs: DataFrame, trees: Trees, with_text: bool) -> DataFrame:
    """docs (doc_id, text, and what the groups before have found, if any) after one more group of languages.

    least is the shortest code length, lang_pred whose it is, total the sum of 2 ** (least - length) over all languages.
    """
    shared, again = docs.sparkSession.sparkContext.broadcast(trees), "least" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.unfold()
        names = np.array(shared.value.langs, object)
        for b in batches:
            text = _lowered(b.column(1))
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            for lo, hi, data, offsets in chunks(text, 1 << 19):
                bits = tables.bits(data, offsets)
                lang = names[bits.argmin(1)]
                least = bits.min(1)
                if again:
                    before = b.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    old = b.column(2).slice(lo, hi - lo).to_pylist()
                    old_total = b.column(4).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                    lang = np.where(least < before, lang, np.array(old, object))
                    now = np.minimum(least, before)
                    total = old_total * np.exp2(np.maximum(now - before, -1000)) + np.exp2(np.maximum(now[:, None] - bits, -1000)).sum(1)
                    least = now
                else:
                    total = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
                lang = pc.if_else(letters.slice(lo, hi - lo), pa.array(lang, pa.string()), pa.scalar("und"))
                kept = b.column(1).slice(lo, hi - lo) if with_text else pa.nulls(hi - lo, pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), kept, lang, pa.array(least), pa.array(total), pa.array(np.diff(offsets).astype(np.int64))], ["doc_id", "text", "lang_pred", "least", "total", "bytes"])

    return docs.mapInArrow(run, "doc_id long, text string, lang_pred string, least double, total double, bytes long")


def predict(docs: DataFrame, groups: Iterable[Trees], id_col: str = "doc_id") -> DataFrame:
    """id_col, lang_pred, score, bits_per_byte for each row of docs; only its id and text are read."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    groups = iter(groups)
    trees = next(groups, None)
    while trees:
        more = next(groups, None)
        out = _compared(out, trees, more is not None)
        if more:
            out = stage(out, "language-passes")
        trees = more
    if "least" not in out.columns:
        out = out.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("least"), F.lit(1.0).alias("total"), F.lit(1).alias("bytes"))
    known = F.col("lang_pred") != "und"
    score, rate = F.lit(1.0) / F.col("total"), F.col("least") / F.greatest("bytes", F.lit(1))
    return out.select(F.col("doc_id").alias(id_col), "lang_pred", F.when(known, score).otherwise(0.0).alias("score"), F.when(known, rate).otherwise(0.0).alias("bits_per_byte"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return predict(docs, groups).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
