"""Nearest neighbours by cosine: a forest of sorted hash-prefix arrays.

Each vector has a long hash string for each of TREES trees: DIGITS digits, each the nearest of the 2 * AXES directions of a random frame, so that of two
vectors at cosine s a digit agrees with odds p(s). A task takes its vectors in segments and sorts each tree's strings. A query descends to the longest
prefix that it shares with any string of the segment and then ascends, in all trees at once, to shorter prefixes; what shares them is scored. It
stops as soon as a vector as near as its last best would have been met with odds 1 - MISS: at a prefix of d digits these are 1 - (1 - p(s)^d)^TREES.
So the prefix's length follows from the query's own neighbours and not from a count, and recall is the same at any number of rows.

Queries whose last best over all segments is so far that not even prefixes of one digit keep that promise ascend to the empty prefix, which is
every vector. Scores are exact: a product in single precision leaves a pair only if it is below the last best by more than its error can be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import ship, tidy, written

#: Trees, digits of a string (7 bits each, 63 in all), axes of a digit's frame, odds with which a neighbour may be missed.
TREES, DIGITS, AXES, MISS = 40, 9, 64, 0.08
BITS = 7
#: Vectors whose strings are sorted together: what a task holds.
SEGMENT = 1 << 16
#: Bytes of a block of queries in double precision. Numbers of a product held at once, and of the pairs scored at once.
BLOCK_BYTES, PRODUCT, PAIRS = 8 << 20, 4 << 20, 1 << 19


@lru_cache(maxsize=1)
def _odds() -> tuple[np.ndarray, np.ndarray]:
    """Cosines and the odds that a digit agrees, from random pairs: with a random frame they depend on nothing else."""
    rng = np.random.default_rng(41)
    cosines, (g, h) = np.linspace(0, 1, 41), rng.normal(size=(2, 20_000, AXES)).astype(np.float32)
    first = _digits(g)
    odds = [np.mean(first == _digits(np.float32(c) * g + np.float32(np.sqrt(1 - c * c)) * h)) for c in cosines]
    return cosines, np.maximum.accumulate(odds)


def enough(score: np.ndarray) -> np.ndarray:
    """The longest prefix that meets a vector of cosine ``score`` with odds 1 - MISS in some tree; 0 if even one digit does not."""
    p = np.clip(np.interp(np.maximum(score, 0), *_odds()), 1e-9, 1 - 1e-9)
    return np.minimum(np.log(1 - MISS ** (1 / TREES)) / np.log(p), DIGITS).astype(np.int64)


def _digits(x: np.ndarray) -> np.ndarray:
    """The nearest direction along the last axis: its number, and one more if it points the other way."""
    up, down = x.argmax(-1), x.argmin(-1)
    high = np.take_along_axis(x, up[..., None], -1)[..., 0] >= -np.take_along_axis(x, down[..., None], -1)[..., 0]
    return np.where(high, 2 * up, 2 * down + 1)


@lru_cache(maxsize=2)
def _frames(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).normal(size=(dim, TREES * DIGITS * AXES)).astype(np.float32)


def strings(unit: np.ndarray) -> np.ndarray:
    """The TREES strings of each vector, as numbers whose first digit is the highest."""
    out = np.zeros((len(unit), TREES), np.uint64)
    for a in range(0, len(unit), 256):
        digits = _digits((unit[a : a + 256] @ _frames(unit.shape[1])).reshape(-1, TREES, DIGITS, AXES)).astype(np.uint64)
        for d in range(DIGITS):
            out[a : a + 256] |= digits[:, :, d] << np.uint64(BITS * (DIGITS - 1 - d))
    return out


def error(dim: int) -> float:
    """A bound of the difference between a single-precision product of two unit vectors and their cosine, in any order of summation.

    Rounding both vectors to single precision costs 2 units u = 2^-24 of sum |x y| <= 1, products and sums dim * u / (1 - dim * u); numbers that
    vanish in single precision at most dim * 2^-126. This is more than twice as much, which covers the double precision of the scores too.
    """
    return 2.0 * (dim + 8) * 2.0**-24 / max(0.5, 1 - dim * 2.0**-24)


def _scaled(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors by their largest component, which changes no cosine, so that squares neither overflow nor vanish; and their lengths."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def _unit(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (x / length[:, None]).astype(np.float32)


@dataclass
class Best:
    """The ``keep`` best (score, cid) of each query of a block, and the prefix by which each was met; places not filled yet score -inf."""

    x: np.ndarray
    length: np.ndarray
    keep: int
    unit: np.ndarray = field(init=False)

    def __post_init__(self):
        self.unit = _unit(self.x, self.length)
        self.score = np.full((len(self.x), self.keep), -np.inf)
        self.cid = np.full((len(self.x), self.keep), np.iinfo(np.int64).max)
        self.level = np.zeros((len(self.x), self.keep), np.int64)
        self.slack = error(self.x.shape[1])

    def add(self, cid: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        """Score all vectors for all queries."""
        unit, step = _unit(x, length), max(1, PRODUCT // max(1, len(x)))
        for a in range(0, len(self.x), step):
            product = self.unit[a : a + step] @ unit.T
            least = self.score[a : a + step, -1] - self.slack
            if np.isneginf(least).any() and len(x) > self.keep:
                # exact scores of this block's own best are not far below their products
                least = np.maximum(least, -np.partition(-product, self.keep - 1, axis=1)[:, self.keep - 1] - 2 * self.slack)
            # rounded up, the bound would lose pairs
            q, v = np.nonzero(product >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
            self._take(q + a, v, cid, x, length, 0)

    def add_pairs(self, q: np.ndarray, v: np.ndarray, cid: np.ndarray, x: np.ndarray, length: np.ndarray, unit: np.ndarray, level: int) -> None:
        """Score pairs, which are sorted by query."""
        product = np.concatenate([np.einsum("ij,ij->i", self.unit[q[a : a + (1 << 16)]], unit[v[a : a + (1 << 16)]]) for a in range(0, len(q), 1 << 16)])
        least = self.score[q, -1] - self.slack
        if np.isneginf(least).any():
            order = np.lexsort((-product, q))
            met, first, n = np.unique(q, return_index=True, return_counts=True)
            own = np.where(n >= self.keep, product[order[np.minimum(first + self.keep - 1, len(q) - 1)]].astype(np.float64) - 2 * self.slack, -np.inf)
            least = np.maximum(least, np.repeat(own, n))
        good = product >= least
        self._take(q[good], v[good], cid, x, length, level)

    def _take(self, q: np.ndarray, v: np.ndarray, cid: np.ndarray, x: np.ndarray, length: np.ndarray, level: int) -> None:
        # a query's pairs are next to each other
        for a in range(0, len(q), PAIRS):
            i, j = q[a : a + PAIRS], v[a : a + PAIRS]
            self._merge(i, cid[j], self._exact(i, j, x, length), level)

    def _exact(self, q: np.ndarray, v: np.ndarray, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(q)), max(1, PRODUCT // x.shape[1])
        for a in range(0, len(q), step):
            i, j = q[a : a + step], v[a : a + step]
            out[a : a + step] = (x[j] * self.x[i]).sum(1) / (length[j] * self.length[i])
        return out

    def _merge(self, q: np.ndarray, cid: np.ndarray, score: np.ndarray, level: int) -> None:
        met = np.unique(q)
        q = np.concatenate([np.repeat(met, self.keep), q])
        level = np.concatenate([self.level[met].ravel(), np.full(len(cid), level)])
        cid, score = np.concatenate([self.cid[met].ravel(), cid]), np.concatenate([self.score[met].ravel(), score])
        order = np.lexsort((-level, cid, -score, q))
        again = np.zeros(len(order), bool)  # the same pair, met by another prefix
        again[1:] = (q[order[1:]] == q[order[:-1]]) & (cid[order[1:]] == cid[order[:-1]]) & np.isfinite(score[order[1:]])
        order = order[~again]
        top = order[(np.searchsorted(q[order], met)[:, None] + np.arange(self.keep)).ravel()]
        for held, new in ((self.cid, cid), (self.score, score), (self.level, level)):
            held[met] = new[top].reshape(-1, self.keep)


class Forest:
    """The sorted strings of a segment's vectors, tree by tree."""

    def __init__(self, keys: np.ndarray):
        self.n = len(keys)
        self.order = np.argsort(keys, axis=0).T.astype(np.int32)
        self.keys = [keys[o, t] for t, o in enumerate(self.order)]
        self.order = self.order.ravel()

    def search(self, best: Best, asked: np.ndarray, cid: np.ndarray, x: np.ndarray, length: np.ndarray) -> None:
        """Descend each query (its strings in ``asked``) to its longest prefix, then ascend in all trees at once until its last best is near enough."""
        unit, trees = _unit(x, length), range(TREES)
        low = np.stack([np.searchsorted(k, asked[:, t]) for t, k in enumerate(self.keys)], axis=1)
        longest = np.zeros(len(asked), np.int64)
        for t, k in enumerate(self.keys):
            for side in (low[:, t] - 1, low[:, t]):
                other = k[np.clip(side, 0, self.n - 1)] ^ asked[:, t]
                shared = sum((other >> np.uint64(BITS * (DIGITS - d)) == 0).astype(np.int64) for d in range(1, DIGITS + 1))
                longest = np.maximum(longest, shared)
        high = low.copy()
        for level in range(int(longest.max(initial=0)), 0, -1):
            q = np.flatnonzero((longest >= level) & (enough(best.score[:, -1]) <= level))
            shift = np.uint64(BITS * (DIGITS - level))
            first = asked[q] >> shift << shift
            last = first | ((np.uint64(1) << shift) - np.uint64(1))
            new_low = np.stack([np.searchsorted(self.keys[t], first[:, t]) for t in trees], axis=1)
            new_high = np.stack([np.searchsorted(self.keys[t], last[:, t], side="right") for t in trees], axis=1)
            start, size = np.concatenate([new_low, high[q]], axis=1), np.concatenate([low[q] - new_low, new_high - high[q]], axis=1)
            start = start + np.tile(np.arange(TREES) * self.n, 2)
            low[q], high[q] = new_low, new_high
            total = np.cumsum(size.sum(1))
            a = 0
            while a < len(q):  # at most PAIRS at once, or those of one query
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
                s, n = start[a:b].ravel(), size[a:b].ravel()
                at = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                pair = np.sort(np.repeat(np.repeat(q[a:b], 2 * TREES), n) * self.n + self.order[at])
                pair = pair[np.diff(pair, prepend=-1) > 0]
                if len(pair):
                    best.add_pairs(pair // self.n, pair % self.n, cid, x, length, unit, level)
                a = b


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SEGMENT:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, TREES)


def _search(sent, keep: int):
    """q, cid, score, prefix: of each query of a block the best of a task's vectors; without strings, of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, length, asked = sent.value
        best = Best(x, length, keep)
        for part in _segments(batches):
            cid, (y, size) = part.column("cid").to_numpy(), _scaled(part.column("e").combine_chunks(), x.shape[1])
            if asked is None:
                best.add(cid, y, size)
            else:
                Forest(_keys(part.column("keys"))).search(best, asked, cid, y, size)
        q, k = np.nonzero(np.isfinite(best.score))
        for a in range(0, len(q), 1 << 16):
            i, j = q[a : a + (1 << 16)], k[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i], pa.int64()), pa.array(best.cid[i, j], pa.int64()), pa.array(best.score[i, j]), pa.array(best.level[i, j], pa.int32())], ["q", "cid", "score", "prefix"])

    return run


def _blocks(asked: DataFrame, dim: int) -> Iterator[tuple]:
    """Ids, vectors, lengths and strings of the queries, in blocks; the driver holds no more than a block and a partition of them."""
    held: list = []
    step = max(1, BLOCK_BYTES // (8 * dim))

    def block() -> tuple:
        keys = np.array([r["keys"] for r in held], np.int64).view(np.uint64) if "keys" in held[0] else None
        return np.array([r["cid"] for r in held], np.int64), *_scaled(pa.array([r["e"] for r in held], pa.list_(pa.float64())), dim), keys

    for r in asked.toLocalIterator():
        held.append(r)
        if len(held) == step:
            yield block()
            held = []
    if held:
        yield block()


def _scored(classes: DataFrame, asked: DataFrame, dim: int, keep: int) -> DataFrame | None:
    """q, cid, score, prefix of the queries ``asked`` among ``classes``, a scan for each block; written. None without queries."""
    found = None
    for block in _blocks(asked, dim):
        sent = classes.sparkSession.sparkContext.broadcast(block)
        columns = ["cid", "e", "keys"] if block[3] is not None else ["cid", "e"]
        part = written(classes.select(*columns).mapInArrow(tidy(_search(sent, keep)), "q long, cid long, score double, prefix int"), "ann-found")
        sent.destroy()
        found = part if found is None else found.union(part)
    return found


def _best(found: DataFrame, keep: int) -> DataFrame:
    """q, cid, score, prefix: the ``keep`` best of each query, a pair met in several ways once."""
    once = found.groupBy("q", "cid").agg(F.max("score").alias("score"), F.max("prefix").alias("prefix"))
    return once.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))).filter(F.col("_r") <= keep).drop("_r")


def _nearest(rows: DataFrame, dim: int, every: int, k: int) -> DataFrame | None:
    """query_id, rank, vec_id, score, prefix among rows (vec_id, row, e, h) of one length."""
    w = Window.partitionBy("h", "e").orderBy("vec_id", "row")
    classes = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).groupBy("h", "e").agg(F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("ids"))
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "row", "h", "e")
    asked_classes = asked.select("h", "e").distinct().withColumn("asked", F.lit(True))
    classes = classes.join(asked_classes, ["h", "e"], "left").select("h", "e", "ids", F.col("ids")[0]["row"].alias("cid"), F.coalesce("asked", F.lit(False)).alias("asked"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = strings(_unit(*_scaled(batch.column("e"), dim))).view(np.int64).ravel()
                column = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * TREES, pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "keys"])

    classes = written(classes.mapInArrow(tidy(hashed), "h long, e array<double>, ids array<struct<vec_id:long,row:long>>, cid long, asked boolean, keys array<long>"), "ann-strings")

    # own class included, k + 1 classes hold all that can be reported
    found = _scored(classes, classes.filter("asked").select("cid", "e", "keys"), dim, k + 1)
    if found is None:
        return None
    grid = np.linspace(0, 1, 4001)
    least = float(grid[np.argmax(enough(grid) > 0)])
    near = _best(found, k + 1).groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter((F.col("n") > k) & (F.col("last") >= least))
    rest = classes.filter("asked").join(near, F.col("cid") == F.col("q"), "left_anti").select("cid", "e")
    more = _scored(classes, rest, dim, k + 1)
    best = _best(found if more is None else found.union(more), k + 1)
    top = best.join(classes.select("cid", "ids"), "cid").select("q", "ids", "score", "prefix")

    own = asked.join(classes.select("h", "e", F.col("cid").alias("q")), ["h", "e"]).select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "q")
    out = own.join(top, "q").select("query_id", "own", "score", "prefix", F.explode("ids").alias("id")).filter("id.row <> own").select("query_id", "own", "score", "prefix", "id.*")
    rank = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "prefix")


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score, prefix: the ``k`` nearest rows of ``vectors`` (vec_id, embedding) to each whose vec_id is divisible by ``every``.

    score is the cosine in double precision on the original vectors; ties go to the smaller vec_id; prefix is the number of digits of the longest
    prefix by which the pair was met, 0 for the empty one. Vectors that are null, all zero or hold a null, NaN or infinite component take no
    part, nor do those without a vec_id; vectors of different lengths are not compared. Rows that repeat a vec_id are rows of their own, as queries and as neighbours. Equal
    vectors are searched for once and keep their k + 1 first rows by vec_id, which are all that can be reported. Other columns are ignored; with no
    other row a query has no result. A task holds a segment of vectors and a block of queries, whatever the table's size and however long a vector is.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).filter(F.col("vec_id").isNotNull() & F.col("e").isNotNull())
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(~bad & F.exists("e", lambda x: x != 0))
    rows = written(rows.withColumns({"h": F.xxhash64("e"), "row": F.monotonically_increasing_id()}), "ann-rows")
    out = None
    for size in sorted(r["d"] for r in rows.select(F.size("e").alias("d")).distinct().collect()):
        found = _nearest(rows.filter(F.size("e") == size), size, every, k)
        if found is not None:
            out = found if out is None else out.union(found)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, prefix int") if out is None else out
