"""Telemetry on streams: the drift monitor, whose state is bounded for each session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engrama.operators import telemetry

ROW = "session_id string, seq long, hit boolean, hit_rate double, drift double, alert boolean"
STATE = "n long, weighted binary, recent binary, hits binary, dim int"


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / (e.sum() + 1e-12)


def js_divergence(p: np.ndarray, q: np.ndarray) -> float:
    m = (p + q) / 2
    kl = lambda a, b: float((a * np.log((a + 1e-12) / (b + 1e-12))).sum())
    return 0.5 * kl(p, m) + 0.5 * kl(q, m)


class Monitor:
    """The rolling hit rate, the recent mean and the historical centroid of one session."""

    def __init__(self, dim: int):
        self.n, self.weighted = 0, np.zeros(dim)
        self.recent, self.hits = np.zeros((0, dim)), np.zeros(0, np.uint8)

    def add(self, vector: np.ndarray, hit: bool) -> tuple[float, float, bool]:
        """(hit_rate, drift, alert) after one more query."""
        self.n += 1
        self.weighted = self.weighted + self.n * vector
        self.recent = np.vstack([self.recent, vector])[-telemetry.MEAN_WINDOW :]
        self.hits = np.append(self.hits, np.uint8(hit))[-telemetry.RATE_WINDOW :]
        rate, drift = float(self.hits.mean()), 0.0
        if self.n >= telemetry.MEAN_WINDOW:
            drift = js_divergence(softmax(self.recent.mean(0)), softmax(2 * self.weighted / (self.n * (self.n + 1))))
        return rate, drift, self.n >= telemetry.MEAN_WINDOW and (rate < telemetry.LEAST_RATE or drift > telemetry.MOST_DRIFT)

    def dump(self) -> tuple:
        return self.n, self.weighted.tobytes(), self.recent.tobytes(), self.hits.tobytes(), len(self.weighted)

    @classmethod
    def load(cls, state: tuple) -> Monitor:
        n, weighted, recent, hits, dim = state
        out = cls(dim)
        out.n, out.weighted = n, np.frombuffer(weighted)
        out.recent, out.hits = np.frombuffer(recent).reshape(-1, dim), np.frombuffer(hits, np.uint8)
        return out


def monitored(stream: DataFrame, hit: float = telemetry.COLD) -> DataFrame:
    """ROW for each query (session_id, seq, qv, best_similarity) of a stream; queries of a session must come in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        monitor = Monitor.load(state.get) if state.exists else Monitor(len(rows["qv"].iloc[0]))
        out = []
        for seq, v, best in zip(rows["seq"], rows["qv"], rows["best_similarity"], strict=True):
            out.append((key[0], seq, best >= hit, *monitor.add(np.asarray(v, float), best >= hit)))
        state.update(monitor.dump())
        yield pd.DataFrame(out, columns=["session_id", "seq", "hit", "hit_rate", "drift", "alert"])

    return stream.groupBy("session_id").applyInPandasWithState(run, ROW, STATE, "append", GroupStateTimeout.NoTimeout)
