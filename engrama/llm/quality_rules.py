"""Learned decision lists of quality rules: sequential covering over labelled statistics, emitted as Spark conditionals.

Rules are conjunctions of thresholds on statistics of a text. One is grown, a condition at a time, by information gain on
two thirds of the labelled rows, pruned from its end on the other third, and kept if it is precise there; the rows that it
covers are removed and the next one is grown. The ordered list becomes one CASE expression, whose first rule that holds
decides. It is fitted on a bounded sample: of the labelled documents, about max_labelled (6,000) by a hash of their id.

Cases: a null or empty text has zero counts and fails the base rule; labels without a document, null labels and documents
without labels are ignored in fitting; a document labelled twice counts twice; without labels of both kinds the list is
empty and the base rule alone decides; repeated rows are each judged; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .doc_stats import COUNT_TYPES, COUNTS, count_batches

MAX_LABELLED = 6000


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: str = "") -> DataFrame:
    """id_col as doc_id, COUNTS and, if named, the long column extra; from whole texts."""
    keep = [F.col(id_col).cast("long").alias("doc_id"), *([F.col(extra).cast("long")] if extra else []), F.col(text_col).alias("text")]
    schema = pa.schema([("doc_id", pa.int64()), *([(extra, pa.int64())] if extra else []), *[(c, pa.int64()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_batches(batches, schema)

    return docs.select(*keep).mapInArrow(run, f"doc_id long, {extra + ' long, ' if extra else ''}{COUNT_TYPES}")


def ratios() -> dict[str, Column]:
    """What rules test, from COUNTS."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    letters = F.greatest(c["n_upper"] + c["n_lower"], F.lit(1.0))
    return {
        "words": c["n_words"],
        "word_length": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words,
        "dup_lines": c["n_dup_lines"] / lines,
        "repeat_words": c["n_repeat_words"] / words,
        "doubled": c["n_doubled"] / words,
        "upper": c["n_upper"] / letters,
        "digits": c["n_digits"] / F.greatest(c["word_chars"], F.lit(1.0)),
        "shouts": c["n_shouts"] / words,
        "stops": c["n_stops"] / words,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


@dataclass
class Rule:
    """All of (feature, above, threshold) hold; above: value > threshold, else value <= threshold."""

    tests: list[tuple[int, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.tests:
            out &= (x[:, f] > t) == above
        return out


def _grow(x: np.ndarray, y: np.ndarray, most_tests: int, cuts: int) -> Rule:
    rule, inside = Rule(), np.ones(len(x), bool)
    while len(rule.tests) < most_tests and (~y[inside]).any():
        p0, n0 = y[inside].sum(), inside.sum()
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            v = x[inside, f]
            levels = np.unique(np.quantile(v[y[inside]], np.linspace(0, 1, cuts)))
            for t in np.unique(np.concatenate([levels, np.nextafter(levels, -np.inf)])):
                for above in (True, False):
                    hit = (v > t) == above
                    p, n = y[inside][hit].sum(), hit.sum()
                    if p and n < n0 and (g := p * (np.log2(p / n) - np.log2(p0 / n0))) > gain:
                        best, gain = (f, above, float(t)), g
        if best is None:
            break
        rule.tests.append(best)
        inside = rule.covers(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, y: np.ndarray) -> Rule:
    def worth(k: int) -> float:
        hit = Rule(rule.tests[:k]).covers(x)
        p, n = (hit & y).sum(), (hit & ~y).sum()
        return (p - n) / max(p + n, 1)

    lengths = range(len(rule.tests), 0, -1)
    return Rule(rule.tests[: max(lengths, key=lambda k: (worth(k), -k))]) if rule.tests else rule


def learn(x: np.ndarray, bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, precision: float = 0.9, cuts: int = 24, seed: int = 7) -> list[Rule]:
    """Ordered rules for rows that are bad."""
    rules: list[Rule] = []
    rng = np.random.default_rng(seed)
    while len(rules) < most_rules and bad.sum() >= 5 and (~bad).sum() >= 5:
        part = rng.random(len(x)) < 2 / 3
        rule = _prune(_grow(x[part], bad[part], most_tests, cuts), x[~part], bad[~part])
        hit, held = rule.covers(x), rule.covers(x) & ~part
        if not rule.tests or not hit.any() or bad[hit].mean() < precision or held.any() and bad[held].mean() < precision:
            break
        rules.append(rule)
        x, bad = x[~hit], bad[~hit]
    return rules


def as_column(rules: list[Rule], features: dict[str, Column]) -> Column:
    """The verdict: false from the first rule that holds, else true."""
    columns, out = list(features.values()), None
    for rule in rules:
        test = F.lit(True)
        for f, above, t in rule.tests:
            test = test & (columns[f] > F.lit(t) if above else columns[f] <= F.lit(t))
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs with their label as _label, of about `most` labels by a hash of the id; the labels are broadcast."""
    given = labels.select(F.col(id_col).alias("_lid"), F.col(label).cast("long").alias("_label")).where("_lid is not null and _label is not null")
    share = min(1.0, most / max(given.count(), 1))
    given = given.where(F.shiftrightunsigned(F.xxhash64("_lid", F.lit("sample")), 2) <= int(share * (1 << 62)))
    return docs.join(F.broadcast(given), F.col(id_col) == F.col("_lid")).drop("_lid")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED, **options) -> list[Rule]:
    """Rules for label = 0; only numbers of about max_labelled rows come to the driver."""
    features = ratios()
    rows = statistics(labelled_sample(docs, labels, label, max_labelled), extra="_label").select("_label", *[c.alias(k) for k, c in features.items()]).toPandas()
    return learn(rows[list(features)].to_numpy(float), rows["_label"].to_numpy() == 0, **options) if len(rows) else []


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept."""
    out = statistics(docs).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & as_column(rules, ratios()))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(docs, fit(docs, labels)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
