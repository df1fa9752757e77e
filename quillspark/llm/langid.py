"""Language identification by a byte convolutional network, trained in numpy on labelled texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ship, slices, tidy

#: Bytes of a window; filters of each width; widths of the filters.
WINDOW, FILTERS, WIDTHS = 128, 16, (2, 3, 4)
#: The model learns from at most so many documents of each language, so many of all (LEAST of each in any case), and so many windows of each.
TRAIN_DOCS, TRAIN_ALL, LEAST, TRAIN_WINDOWS = 600, 24_000, 20, 6
UNKNOWN = "und"


def windows(raw: bytes) -> np.ndarray:
    """All of ``raw`` as rows of WINDOW bytes, the last padded with zeros."""
    rows = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(rows * WINDOW, b"\0"), np.uint8).reshape(rows, WINDOW)


@dataclass
class Model:
    """tables[i][k] holds what byte k places on adds to the filters of width WIDTHS[i]: a convolution of one-hot bytes."""

    langs: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def pairs(self) -> list[list[np.ndarray]]:
        """The tables of two neighbouring places, summed for each pair of bytes: half the look-ups."""
        out = []
        for t in self.tables:
            two = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(t) - 1, 2)]
            out.append(two + ([t[-1]] if len(t) % 2 else []))
        return out

    def log_probs(self, x: np.ndarray, pairs: list[list[np.ndarray]]) -> np.ndarray:
        """Of each window; rows of 128 bytes are handled in blocks that stay in cache."""
        out = []
        for i in range(0, len(x), 256):
            part = x[i : i + 256]
            codes = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            pooled = []
            for width, tables in zip(WIDTHS, pairs, strict=True):
                n = WINDOW - width + 1
                total = tables[0].take(codes[:, :n], axis=0)
                for k, t in enumerate(tables[1:], 1):
                    total += t.take(codes[:, 2 * k : 2 * k + n] if len(t) == 65536 else part[:, 2 * k : 2 * k + n], axis=0)
                pooled.append(total.max(1))
            h = np.maximum(np.hstack(pooled) + self.bias, 0)
            z = h @ self.dense + self.dense_bias
            z -= z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)

    def predict(self, texts: list[str | None], pairs: list[list[np.ndarray]]) -> tuple[list[str], np.ndarray]:
        """Of each whole text: its windows' log probabilities, by their bytes; texts without a letter are UNKNOWN with score 0."""
        known = [bool(self.langs) and any(map(str.isalpha, t or "")) for t in texts]
        raws = [t.encode() for t, k in zip(texts, known, strict=True) if k]
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if raws:
            rows = [windows(r) for r in raws]
            first = np.cumsum([0, *map(len, rows)])
            logs = self.log_probs(np.concatenate(rows), pairs)
            weight = np.full(len(logs), WINDOW, np.float64)
            weight[first[1:] - 1] = [len(r) - WINDOW * (len(w) - 1) for r, w in zip(raws, rows, strict=True)]
            z = np.add.reduceat(logs * weight[:, None], first[:-1], axis=0) / np.array([len(r) for r in raws])[:, None]
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            for i, best, s in zip(np.flatnonzero(known), p.argmax(1), p.max(1), strict=True):
                langs[i], scores[i] = self.langs[best], s
        return langs, scores


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Model:
    """Adam on the softmax loss. Windows are cut short at random, so that short texts are learnt too."""
    rng, c = np.random.default_rng(seed), len(langs)
    p = {f"t{i}": rng.normal(0, 0.1, (w, 256, FILTERS)) for i, w in enumerate(WIDTHS)}
    p |= {"b": np.zeros(FILTERS * len(WIDTHS)), "d": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), c)), "o": np.zeros(c)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), batch):
            rows = x[order[i : i + batch]].copy()
            short = rng.random(len(rows)) < 0.4
            for r in np.flatnonzero(short):
                rows[r, rng.integers(6, WINDOW) :] = 0
            pooled, where = [], []
            for k, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                total = sum(p[f"t{k}"][j].take(rows[:, j : j + n], axis=0) for j in range(w))
                at = total.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(total, at[:, None, :], 1)[:, 0, :])
            pre = np.hstack(pooled) + p["b"]
            h = np.maximum(pre, 0)
            z = h @ p["d"] + p["o"]
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(rows)), y[order[i : i + batch]]] -= 1
            z /= len(rows)
            dh = (z @ p["d"].T) * (pre > 0)
            g = {"d": h.T @ z, "o": z.sum(0), "b": dh.sum(0)}
            for k, w in enumerate(WIDTHS):
                d, table = dh[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(p[f"t{k}"])
                for j in range(w):
                    seen = np.take_along_axis(rows, where[k] + j, 1)
                    np.add.at(table[j], (seen, np.arange(FILTERS)[None, :]), d)
                g[f"t{k}"] = table
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, [p[f"t{i}"].astype(np.float32) for i in range(len(WIDTHS))], p["b"].astype(np.float32), p["d"].astype(np.float32), p["o"].astype(np.float32))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Learn from text and lang of rows that are not held out: windows from anywhere in a sample of each language's texts."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").count()
    langs = sorted(r["lang"] for r in counts.select("lang").collect())  # every language is learnt: a row for each
    if not langs:
        return Model([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    each = max(LEAST, min(TRAIN_DOCS, TRAIN_ALL // len(langs)))
    share = counts.select("lang", F.least(F.lit(1.0), each / F.col("count")).alias("share"))
    picked = own.join(share, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < 1_000_000 * F.col("share")).select("doc_id", "text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: tuple[list[bytes], list[str]] = ([], [])
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                rows = windows(text.encode())
                rng = np.random.default_rng(len(text) + 1000 * int(rows[0, 0]))
                for r in rows[np.sort(rng.permutation(len(rows))[:TRAIN_WINDOWS])]:
                    out[0].append(r.tobytes())
                    out[1].append(lang)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.string())], ["w", "lang"])

    found = picked.mapInArrow(tidy(cut), "w binary, lang string").limit(2 * each * TRAIN_WINDOWS * len(langs)).toArrow()
    pairs = sorted(zip(found.column("lang").to_pylist(), found.column("w").to_pylist(), strict=True))  # the order of arrival is not fixed
    if not pairs:
        return Model([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    x = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, WINDOW)
    place = {k: i for i, k in enumerate(langs)}
    return fit(x, np.array([place[k] for k, _ in pairs]), langs)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs`` (doc_id, text, lang).

    ``lang`` is read only to learn, and only of rows that are not held out. Texts that are null, empty or without any letter are ``und`` with
    score 0, and so are all where nothing can be learnt. A null doc_id is not held out. Other columns are ignored. All windows of a very long text
    count; a task holds them at once, some 200 times the text's bytes of a slice of 2 MB or of one text.
    """
    ship(docs.sparkSession)
    model = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = model.pairs()
        for batch in slices(batches):
            langs, scores = model.predict(batch.column("text").to_pylist(), pairs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
