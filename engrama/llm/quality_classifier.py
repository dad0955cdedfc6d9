"""Quality classifier by co-training of two views.

The text view sees shares of byte-class pairs and repetition; the metadata view sees source, language and length. Each is a
logistic regression, fitted on about max_labelled (6,000) labelled documents, drawn by a hash of their id. In every round
both views score all documents without a label, in Spark; each view takes the per_round (200) of which it is surest, in the
proportions of the labels, by a distributed top-k, and hands them to the other view as training rows. Only the numbers of
those rows come to the driver. Afterwards each view is calibrated on labelled rows held back from training (Platt scaling), a
third logistic regression combines the calibrated log-odds, and all documents are scored in one pass. No labelled document is
ever pseudo-labelled, so that the rows held back stay unseen.

Cases: a null text counts as empty; documents without an id are scored, but not handed over; of several rows under one id
that is handed over, the smallest stands for it; null metadata is a value of its own; a text without a word is rejected; without labels
of both kinds every document with a word has score 0.5 and stays; documents labelled twice count twice; repeated rows are
each scored; extra columns are ignored, and survive in filter_quality.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_text as at
from .common import stage
from .doc_stats import TEXT_FEATURES, text_features
from .quality_rules import labelled_sample

SLOTS = 64
META_FEATURES = SLOTS + 24
COLUMNS = ("text", "source", "lang", "n_chars")


def meta_features(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, and bins of the logarithm of the length."""
    out = np.zeros((len(source), META_FEATURES), np.float32)
    rows = np.arange(len(source))
    slot = lambda kind, values: np.array([zlib.crc32(f"{kind}:{v}".encode()) % SLOTS for v in values], np.int64)
    for kind, values in (("s", source), ("l", lang)):
        np.add.at(out, (rows, slot(kind, values)), 1)
    length = np.log2(np.array([max(v or 0, 0) for v in n_chars], float) + 1)
    out[rows, SLOTS + np.minimum(length.astype(np.int64), 22)] = 1
    out[:, -1] = length / 16
    return out


@dataclass
class Logistic:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
        """Newton's method with a ridge penalty; both kinds weigh the same."""
        x = x.astype(float)
        mean, scale = x.mean(0), x.std(0) + 1e-3
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        w = np.where(y, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        beta, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            gradient = z.T @ (w * (p - y)) + penalty * beta
            step = np.linalg.solve((z * (w * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), gradient)
            beta -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-5:
                break
        return cls(mean, scale, beta[:-1], float(beta[-1]))


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    calibrate_text: Logistic
    calibrate_meta: Logistic
    combine: Logistic

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities that the quality is good: combined, by text, by metadata."""
        t = self.calibrate_text.log_odds(self.text.log_odds(text)[:, None])
        m = self.calibrate_meta.log_odds(self.meta.log_odds(meta)[:, None])
        c = self.combine.log_odds(np.stack([t, m], 1))
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (c, t, m))


class CoTraining:
    """Two views on labelled rows (y: 1 good, 0 bad), and what each has been handed by the other."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, seed: int = 3):
        held = np.random.default_rng(seed).random(len(y)) < 0.3
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.arange(len(y)) % 2 == 0
            if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
                held = np.zeros(len(y), bool)
        self.views, self.y, self.fit_on = (text, meta), y, ~held
        self.check = held if held.any() else np.ones(len(y), bool)
        self.extra: tuple[list, list] = ([], [])
        self.models = self._train()

    def _train(self) -> list[Logistic]:
        out = []
        for own, handed in zip(self.views, self.extra, strict=True):
            x, t = [own[self.fit_on], *[f for f, _ in handed]], [self.y[self.fit_on], *[labels for _, labels in handed]]
            out.append(Logistic.fit(np.vstack(x), np.concatenate(t)))
        return out

    def quotas(self, per_round: int) -> tuple[int, int]:
        """How many good and bad ones a view hands over in a round."""
        good = self.y[self.fit_on].mean()
        return max(1, int(per_round * good)), max(1, int(per_round * (1 - good)))

    def next_round(self, handed: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Train again with rows (view that is sure, text, meta, labels), which the other view gets."""
        for view, text, meta, labels in handed:
            self.extra[1 - view].append(((text, meta)[1 - view], labels))
        self.models = self._train()

    def finish(self) -> CoTrained:
        odds = [m.log_odds(x[self.check]) for m, x in zip(self.models, self.views, strict=True)]
        y = self.y[self.check]
        scaled = [Logistic.fit(o[:, None], y, 0.1) for o in odds]
        both = np.stack([s.log_odds(o[:, None]) for s, o in zip(scaled, odds, strict=True)], 1)
        return CoTrained(*self.models, *scaled, Logistic.fit(both, y, 0.1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in batches:
        for lo, hi, data, offsets in at.chunks(b.column(b.schema.get_field_index("text"))):
            part = b.slice(lo, hi - lo)
            col = lambda name: part.column(part.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            yield part, text_features(data, offsets), meta_features(col("source"), col("lang"), col("n_chars"))


def _numbers(docs: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key (a long) and the features of both views of each row, on the driver: for bounded docs only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, meta in _features(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in meta], pa.binary())], ["key", "text", "meta"])

    rows: pd.DataFrame = docs.select(key, *COLUMNS).mapInArrow(run, "key long, text binary, meta binary").toPandas()
    text, meta = (np.frombuffer(b"".join(rows[c]), np.float32).reshape(len(rows), n) for c, n in (("text", TEXT_FEATURES), ("meta", META_FEATURES)))
    return rows["key"].to_numpy(), text, meta


def surest(docs: DataFrame, labelled: DataFrame, models: list[Logistic], taken: set[int], quotas: tuple[int, int], sure: float) -> dict[int, tuple[int, int]]:
    """{doc_id: (view, label)} of the documents of which a view is surest, neither labelled (doc_id) nor taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, meta in _features(batches):
            odds = np.stack([m.log_odds(x) for m, x in zip(models, (text, meta), strict=True)])
            p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            keep = pa.array(((p >= sure) | (p <= 1 - sure)).any(0))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p[0]), pa.array(p[1])], ["doc_id", "p0", "p1"]).filter(keep)

    all_ = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS)
    scores = all_.mapInArrow(run, "doc_id long, p0 double, p1 double").groupBy("doc_id").agg(F.min("p0").alias("p0"), F.min("p1").alias("p1"))
    scores = stage(scores.join(labelled, "doc_id", "left_anti"), "quality-sure")
    out: dict[int, tuple[int, int]] = {}
    for view in (0, 1):
        p = F.col(f"p{view}")
        for label, n, order in ((1, quotas[0], p.desc()), (0, quotas[1], p.asc())):
            is_sure = p >= sure if label else p <= 1 - sure
            gone = taken | set(out)  # as many as have been handed over, at most
            for r in scores.where(is_sure).where(~F.col("doc_id").isin(gone) if gone else F.lit(True)).orderBy(order, "doc_id").limit(n).collect():
                out[r["doc_id"]] = (view, label)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 6000, rounds: int = 3, per_round: int = 200, sure: float = 0.95) -> CoTrained | None:
    """None without labels of both kinds."""
    y, text, meta = _numbers(labelled_sample(docs.select("doc_id", *COLUMNS), labels, label, max_labelled), "_label")
    if len(set(y)) < 2:
        return None
    training = CoTraining(text, meta, (y > 0).astype(float))
    labelled = labels.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    taken: set[int] = set()
    for _ in range(rounds):
        picks = surest(docs, labelled, training.models, taken, training.quotas(per_round), sure)
        if not picks:
            break
        taken |= set(picks)
        rows = docs.where(F.col("doc_id").isin(list(picks))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.struct(*COLUMNS)).alias("r"))
        ids, text, meta = _numbers(rows.select("doc_id", "r.*"), "doc_id")
        view, labels_ = (np.array([picks[i][k] for i in ids.tolist()]) for k in (0, 1))
        training.next_round([(v, text[view == v], meta[view == v], labels_[view == v].astype(float)) for v in (0, 1) if (view == v).any()])
    return training.finish()


def score(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, text_score, meta_score, kept for each row of docs (doc_id, text, source, lang, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, meta in _features(batches):
            c, t, m = model.scores(text, meta) if model else [np.full(len(text), 0.5)] * 3
            wordless = text[:, TEXT_FEATURES - 7] == 0  # the logarithm of the number of words
            c = np.where(wordless, 0.0, c)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (c, t, m)), pa.array(c >= threshold)], ["doc_id", "score", "text_score", "meta_score", "kept"])

    cols = [F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", "n_chars"]
    return docs.select(*cols).mapInArrow(run, "doc_id long, score double, text_score double, meta_score double, kept boolean")


def filter_quality(docs: DataFrame, model: CoTrained | None, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score of threshold or more, all columns as they are. No shuffle."""
    names = docs.columns
    where = [names.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = pa.RecordBatch.from_arrays([b.column(k) for k in where], ["text", "source", "lang", "n_chars"])
            keep = []
            for _, text, meta in _features(iter([own])):
                c = model.scores(text, meta)[0] if model else np.full(len(text), 0.5)
                keep.append((c >= threshold) & (text[:, TEXT_FEATURES - 7] > 0))
            yield b.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
