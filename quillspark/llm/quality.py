"""Quality scores learnt from preference pairs (Bradley-Terry), thresholded at a score quantile."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ship, slices, tidy

#: The model is fitted on at most so many labelled rows (a hash of the doc_id picks them) and so many pairs.
TRAIN_ROWS, TRAIN_PAIRS = 20_000, 100_000
#: A score of this much or more is kept.
KEEP = 0.3
FEATURES = ("log_words", "word_length", "upper", "digit", "mark", "odd_mark", "pipe", "distinct", "distinct_excess", "top_word", "repeat_next", "distinct_lines", "marked_words", "short_words", "sentence", "not_ascii")
_LETTERS, _UPPER, _DIGITS, _MARKS, _ODD = b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"'()+,-./:;?[]_", b"#$%&*<=>@\\^`{|}~!"
_NOT = {k: bytes(set(range(256)) - set(k)) for k in (_LETTERS, _UPPER, _DIGITS, _MARKS, _ODD)}
_RUN = re.compile(rb"[#$%&*=~^|!]{2,}")


def _share(raw: bytes, kind: bytes) -> float:
    return len(raw.translate(None, _NOT[kind])) / len(raw)


def features(text: str | None) -> list[float]:
    """Counts over the whole text; an empty or null text has zeros."""
    raw = (text or "").encode()
    words = raw.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    n, kinds = len(words), set(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    letters = _share(raw, _LETTERS) + _share(raw, _UPPER)
    return [
        np.log1p(n),
        len(raw) / n,
        _share(raw, _UPPER) / max(letters, 1e-3),
        _share(raw, _DIGITS),
        _share(raw, _MARKS),
        _share(raw, _ODD),
        raw.count(b"|") / n,
        len(kinds) / n,
        len(kinds) / n - min(1.0, 1.8 * n**-0.18),
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(lines)) / len(lines),
        len(_RUN.findall(raw)) / n,
        sum(len(w) < 3 for w in words) / n,
        np.log1p(n / (1 + raw.count(b"."))),
        len(raw.translate(None, bytes(range(128)))) / len(raw),
    ]


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and _features of every row of ``docs`` (doc_id, text); other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "_features"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, _features array<double>")


@dataclass
class Model:
    """Score = sigmoid(weights . basis(features) - cut + logit(KEEP))."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -4, 4)
        return np.hstack([z, z * z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-(self.raw(x) - self.cut + np.log(KEEP / (1 - KEEP)))))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = TRAIN_PAIRS, seed: int = 7, ridge: float = 1e-3, share: float = 0.99) -> Model:
    """Bradley-Terry: logistic loss on basis(preferred) - basis(other) over random pairs, by Newton steps.

    The cut is the score quantile at ``share`` of the part of rows with label 0, so that good rows are lost rather less often than
    bad ones are let through. With one class only, or none, all scores are 0.5.
    """
    width = x.shape[1] if x.ndim == 2 and len(x) else len(FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(np.zeros(width), np.ones(width), np.zeros(4 * width), float(np.log(KEEP / (1 - KEEP))))
    model = Model(x.mean(0), np.maximum(x.std(0), 1e-9), np.zeros(4 * width), 0.0)
    b, rng = model.basis(x), np.random.default_rng(seed)
    pairs = min(pairs, len(good) * len(bad))
    d = b[rng.choice(good, pairs)] - b[rng.choice(bad, pairs)]
    w = model.weights
    for _ in range(12):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # odds that the pair is ranked the wrong way
        grad = d.T @ p / pairs - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 3.0 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-6:
            break
    model.weights = w
    s = b @ w
    model.cut = float(np.quantile(s, share * len(bad) / len(y)))
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> Model:
    """Fit on rows of ``docs`` that have a label and are not held out; at most ``limit`` are read for it and reach the driver."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    labels = labels.groupBy("doc_id").agg(F.max("_y").alias("_y"))
    n = labels.count()
    if n > limit:
        share = int(1e6 * limit / n)
        labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < share)
    labels = F.broadcast(labels)  # about ``limit`` rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(labels, "doc_id")
    found = with_features(own.select("doc_id", "text")).join(labels, "doc_id").select("_features", "_y").limit(2 * limit).toArrow()
    x = np.array(found.column("_features").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = np.array(found.column("_y").to_pylist(), np.int64)
    order = np.lexsort([*x.T[::-1], y])  # the order of arrival is not fixed
    return fit(x[order], y[order])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    Learnt from ``labels`` (doc_id, quality 0 or 1; others and null are ignored, of repeated doc_ids the largest) of rows that are not held
    out. Null, empty and blank texts have all features 0 and a score like any other. A null doc_id is not held out. The words of a very long text are
    counted in one task, some 100 times its bytes. Other columns are ignored.
    """
    ship(docs.sparkSession)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, with their columns, whose score reaches KEEP. The texts are read twice and never shuffled."""
    ship(docs.sparkSession)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) >= KEEP))

    return docs.mapInArrow(tidy(run), docs.schema)
