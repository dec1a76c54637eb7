"""Regularised quadratic discriminant over document statistics.

Each document becomes a few transformed statistics of its whole text. Per class, the mean and covariance come
from sums over all training rows (one aggregate, no sample). Covariances are shrunk towards
the pooled one and towards a scaled identity; their Cholesky factors are computed once
and sent with the tasks. A score is the logistic of the difference of the two Mahalanobis log-densities.

Defined results: a null text is an empty one, whose statistics are all zero, and is scored like
any other; labels that are null or whose document is missing are not used; several labels of a
document count as their mean, ties as 1; without training rows of both classes every score is 0.5
and ``keep`` keeps all documents;
rows with equal or null ids are kept; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import words_of, write_and_read

#: Weight of the pooled covariance and of the scaled identity.
POOLED, IDENTITY = 0.2, 0.1
#: Log-density differences are divided by this before the logistic function: statistics are not independent.
SOFTEN = 2.0

NAMES = ("log_words", "log_word_length", "distinct", "top_word", "same_word", "capitals", "symbols", "bangs", "digits", "stops",
         "bars", "log_line_words", "same_line", "letters")
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _CAPITALS + _CAPITALS.lower() + bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of one text; shares enter as square roots, counts as logarithms."""
    words = words_of(text)
    if not words:
        return [0.0] * len(NAMES)
    raw = text.encode()
    n, size = len(words), len(raw)
    distinct = set(words)
    counts = {}
    if len(distinct) < n:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda chars: ((size - len(raw.translate(None, chars))) / size) ** 0.5
    same = sum(map(str.__eq__, words, words[1:])) / n
    return [np.log1p(n), np.log(sum(map(len, words)) / n), np.log(len(distinct)) / np.log(n) if n > 1 else 1.0,
            (max(counts.values(), default=1) / n) ** 0.5, same ** 0.5, share(_CAPITALS), share(b"#*$%&<>@^~_=+\\{}[]"), share(b"!?"),
            share(b"0123456789"), share(b".,;:"), share(b"|"), np.log1p(n / max(1, len(lines))),
            (1 - len(set(lines)) / max(1, len(lines))) ** 0.5, share(_LETTERS)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text, one column each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([statistics(t) for t in batch["text"]], columns=NAMES, dtype=float)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").values)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


@dataclass
class Discriminant:
    """Means and Cholesky factors of both classes, on standardised statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            away = np.linalg.solve(factor, (z - mean).T)
            logs.append(-0.5 * (away ** 2).sum(axis=0) - log_det)
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / SOFTEN + self.log_prior, -700, 700)))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per document."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(column) >= 0.5).cast("int").alias("label"))


def fit(rows: DataFrame) -> Discriminant | None:
    """From rows of statistics and a label, by sums per class; None unless both classes have rows."""
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
    sums = rows.groupBy("label").agg(
        F.count("*").alias("n"), F.array(*[F.sum(n) for n in NAMES]).alias("s"),
        F.array(*[F.sum(F.col(a) * F.col(b)) for a, b in pairs]).alias("p")).collect()
    if len(sums) < 2:
        return None
    d, total = len(NAMES), {}
    upper = np.triu_indices(d)
    for r in sums:
        square = np.zeros((d, d))
        square[upper] = r["p"]
        total[r["label"]] = r["n"], np.array(r["s"]), square + np.triu(square, 1).T
    n, s, p = (sum(total[k][i] for k in (0, 1)) for i in range(3))
    centre = s / n
    scale = np.sqrt(np.maximum(np.diag(p) / n - centre ** 2, 1e-8))
    means, covariances = [], []
    for k in (0, 1):
        nk, sk, pk = total[k]
        means.append((sk / nk - centre) / scale)
        covariances.append((pk / nk - np.outer(sk / nk, sk / nk)) / np.outer(scale, scale))
    pooled = sum(total[k][0] * covariances[k] for k in (0, 1)) / n
    factors = []
    for k in (0, 1):
        shrunk = (1 - POOLED) * covariances[k] + POOLED * pooled
        shrunk = (1 - IDENTITY) * shrunk + IDENTITY * max(np.trace(pooled) / d, 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(shrunk))
    log_dets = [float(np.log(np.diag(f)).sum()) for f in factors]
    return Discriminant(centre, scale, means, factors, log_dets, float(np.log(total[1][0] / total[0][0])))


def learn(rows: DataFrame, labels: DataFrame) -> Discriminant | None:
    """The discriminant of rows of statistics that are not held out, and their labels."""
    return fit(rows.filter(~F.col("held_out")).join(labels_of(labels, "quality"), "doc_id"))


def keep(docs: DataFrame, labels: DataFrame, held_out: Column, least: float) -> DataFrame:
    """The documents, all columns, with a score of at least ``least``; all of them without training rows of both classes."""
    rows = write_and_read(with_statistics(docs), "statistics").withColumn("held_out", held_out)
    model = learn(rows, labels)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column("text").to_pylist()], float).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.scores(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def score(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out and score of every document; labels of held-out ones are not read."""
    rows = write_and_read(with_statistics(docs), "statistics").withColumn("held_out", held_out)
    model = learn(rows, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[list(NAMES)].to_numpy(float)
            yield batch[["doc_id", "held_out"]].assign(score=model.scores(x) if model else 0.5)

    return rows.mapInPandas(run, "doc_id long, held_out boolean, score double")
