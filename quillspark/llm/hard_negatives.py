"""Hard-negative mining: a norm-bucketed search for the largest inner products inside windows.

Candidates are sorted by norm and dealt into buckets, each of which knows its largest norm. An inner product is at most the product of the norms, so a
window can skip a bucket, and all that follow, once its anchor's norm times the bucket's largest falls below the window's lower limit or below its
running k-th score. Buckets are searched in waves, each four times as large as the last: a wave sends every anchor to the buckets
that its windows still ask for, and the merged best scores set the limits of the next one. Inside a bucket the same bounds hold for slices of it.

Rows are known by a row number of their own, so repeated ids stay rows. A task holds one bucket of candidates; the anchors stream past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import forget, ship, tidy, written

#: Bytes of a bucket's vectors in double precision, on average at most; rows of a bucket at least, where the cores ask for more buckets; rows of a slice.
BUCKET_BYTES, LEAST_ROWS, SLICE = 16 << 20, 256, 1024
#: Anchors whose windows are searched at once; growth of the waves.
ANCHORS, GROWTH = 256, 4
_MOST, _NONE = 2**63 - 1, -(2**63)
_FOUND = "a long, w int, b long, vec_id long, score long"


def quantized(vectors: DataFrame, scale: int = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v of vectors (vec_id, label, embedding): floor(``scale`` * x) of each component, and the next label where vec_id is divisible by ``shift_every``.

    Rows with a null label or vector, or with a component that is null or not finite before or after, are left out.
    """
    label = F.col("label").cast("long")
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * float(scale))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label).alias("label"), v.alias("v"))
    # rounding in the JVM's double arithmetic, as floor() would go through a 64-bit integer
    return out.filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(~bad).withColumn("v", F.transform("v", lambda x: F.rint(x) - F.when(F.rint(x) > x, 1.0).otherwise(0.0)))


def _numbers(column: pa.ChunkedArray, dim: int, kind: object) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    flat = np.array([int(x) for x in flat], object) if kind is object else flat.astype(kind)
    return flat.reshape(-1, dim) if dim else np.zeros((len(column), 0), kind)


def _products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, exact: the kind of the numbers is chosen so that no sum is rounded. Those beyond 64 bits count as the largest."""
    p = a @ c.T if a.shape[1] else np.zeros((len(a), len(c)))
    return np.clip(p, _NONE + 1, _MOST).astype(np.int64) if p.dtype == object else p.astype(np.int64)


class Best:
    """The k best (score, vec_id, row) of each window, best first; empty places have the score _NONE."""

    def __init__(self, windows: int, k: int):
        self.k = k
        self.score = np.full((windows, k), _NONE)
        self.vec_id = np.full((windows, k), _MOST)
        self.row = np.full((windows, k), _MOST)

    def add(self, w: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        met = np.unique(w)
        w = np.concatenate([np.repeat(met, self.k), w])
        score, vec_id, row = (np.concatenate([old[met].ravel(), new]) for old, new in ((self.score, score), (self.vec_id, vec_id), (self.row, row)))
        order = np.lexsort((row, vec_id, -score.astype(np.float64), w)) if np.abs(score[score > _NONE]).max(initial=0) < 2**53 else np.array(sorted(range(len(w)), key=lambda i: (w[i], -int(score[i]), vec_id[i], row[i])))
        top = order[(np.searchsorted(w[order], met)[:, None] + np.arange(self.k)).ravel()]
        for held, new in ((self.score, score), (self.vec_id, vec_id), (self.row, row)):
            held[met] = new[top].reshape(-1, self.k)


def _search(dim: int, kind: object, same: bool, k: int):
    """Stream a bucket's candidates (kind 0, largest norms first) and then its anchors; yields the best of each window."""

    def searched(anchors: list[pa.Table], held: tuple) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(anchors)
        c, ids, rows, labels, norms = held
        a, norm = _numbers(table.column("v"), dim, kind), np.sqrt(table.column("norm2").to_numpy())
        own, label = table.column("row").to_numpy(), table.column("label").to_numpy()
        windows = table.column("windows").combine_chunks()
        at = np.repeat(np.arange(len(a)), np.diff(windows.offsets.to_numpy()))
        flat = windows.flatten()
        w, low, high, last = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("w", "low", "high", "last"))
        best = Best(len(at), k)
        for s in range(0, len(c), SLICE):
            least = np.maximum(np.maximum(low, last), best.score[:, -1])
            # rounded up, as norms are rounded
            live = np.flatnonzero(norm[at] * norms[s] * (1 + 1e-9) + 1 >= least)
            if not len(live):
                break
            asked, back = np.unique(at[live], return_inverse=True)
            score = _products(a[asked], c[s : s + SLICE])
            alike = labels[s : s + SLICE][None, :] == label[asked][:, None]
            fits = alike & (rows[s : s + SLICE][None, :] != own[asked][:, None]) if same else ~alike
            for f in range(0, len(live), 512):
                part, x = live[f : f + 512], back[f : f + 512]
                found = score[x]
                ok = fits[x] & (found >= least[part][:, None]) & (found <= high[part][:, None])
                if ok.shape[1] > k:  # those below a slice's own k-th are out
                    ok &= found >= np.partition(np.where(ok, found, _NONE), -k, axis=1)[:, -k][:, None]
                q, v = np.nonzero(ok)
                if len(q):
                    best.add(part[q], found[q, v], ids[s + v], rows[s + v])
        q, j = np.nonzero(best.score > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(own[at[q]]), pa.array(w[q], pa.int32()), pa.array(best.row[q, j]), pa.array(best.vec_id[q, j]), pa.array(best.score[q, j])], ["a", "w", "b", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, taken, held, waiting = None, [], None, []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            b, is_anchor = batch.column("bucket").to_numpy(), batch.column("anchor").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((b[1:] != b[:-1]) | (is_anchor[1:] != is_anchor[:-1])) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if b[i] != bucket:
                    if waiting:
                        yield from searched(waiting, held)
                    bucket, taken, held, waiting = b[i], [], None, []
                if not is_anchor[i]:
                    taken.append(table.slice(i, j - i))
                    continue
                if not taken:
                    continue
                if held is None:
                    whole = pa.concat_tables(taken)
                    held = _numbers(whole.column("v"), dim, kind), *(whole.column(n).to_numpy() for n in ("vec_id", "row", "label")), np.sqrt(whole.column("norm2").to_numpy())
                for x in range(i, j, ANCHORS):
                    waiting.append(table.slice(x, min(ANCHORS, j - x)))
                    if sum(t.num_rows for t in waiting) >= ANCHORS:
                        yield from searched(waiting, held)
                        waiting = []
        if waiting:
            yield from searched(waiting, held)

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("a", "w").orderBy(F.desc("score"), "vec_id", "b")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _waves(buckets: int, first: int) -> Iterator[range]:
    begin, size = 0, first
    while begin < buckets:
        yield range(begin, min(buckets, begin + size))
        begin, size = begin + size, size * GROWTH


def search(buckets: DataFrame, tops: list[float], anchors: DataFrame, windows: DataFrame, dim: int, kind: object, same: bool, k: int) -> DataFrame:
    """a, w, b, vec_id, score, rank: the k best of each window (a, w, low, high) of anchors among candidates of the same label, or of other labels.

    ``tops`` has the largest squared norm of each bucket, falling: a number for each BUCKET_BYTES of vectors is all that the driver holds.
    """
    spark = buckets.sparkSession
    best = written(spark.createDataFrame([], f"{_FOUND}, rank int"), "negatives-best")
    for wave in _waves(len(tops), max(1, spark.sparkContext.defaultParallelism)):
        last = best.filter(F.col("rank") == k).select("a", "w", F.col("score").alias("last"))
        now = windows.join(last, ["a", "w"], "left").select("a", "w", "low", "high", F.coalesce("last", F.lit(_NONE)).alias("last"))
        now = now.groupBy("a").agg(F.collect_list(F.struct("w", "low", "high", "last")).alias("windows"), F.min(F.greatest("low", "last")).alias("least"))
        asks = now.join(anchors, F.col("a") == F.col("row"))
        # buckets fall in norm, so those that can hold something are the first ones of the wave
        top = F.array(*[F.lit(tops[b]) for b in wave])
        reach = F.size(F.filter(top, lambda t: F.sqrt("norm2") * F.sqrt(t) * (1 + 1e-9) + 1 >= F.col("least").cast("double")))
        sent = asks.withColumn("reach", reach).filter("reach > 0").withColumn("bucket", F.explode(F.sequence(F.lit(wave[0]), F.lit(wave[0] - 1) + F.col("reach"))))
        sent = sent.select("bucket", F.lit(True).alias("anchor"), "row", "vec_id", "label", "norm2", "v", "windows")
        given = buckets.filter(F.col("bucket").between(wave[0], wave[-1])).withColumns({"anchor": F.lit(False), "windows": F.lit(None).cast(sent.schema["windows"].dataType)})
        met = given.unionByName(sent).repartition(len(wave), "bucket").sortWithinPartitions("bucket", "anchor", F.desc("norm2"))
        found = met.mapInArrow(tidy(_search(dim, kind, same, k)), _FOUND)
        after = written(_top(best.drop("rank").union(found), k), "negatives-best")
        forget(best)
        best = after
    return best


def _limit(score: str, percent: int, up: bool) -> Column:
    """percent * score / 100 as a whole number, rounded up or down; scores are not negative."""
    exact = F.col(score).cast("decimal(20,0)") * percent
    return F.least((F.floor((exact + (99 if up else 0)) / 100)).cast("decimal(38,0)"), F.lit(_MOST).cast("decimal(38,0)")).cast("long")


def _mine(rows: DataFrame, dim: int, n: int, most: float, every: int, positives: int, k: int, low: int, high: int) -> DataFrame:
    # no sum of products of components exceeds the largest squared norm
    kind: object = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    deal = max(-(-n * 8 * dim // BUCKET_BYTES), min(4 * cores, n // LEAST_ROWS), 1)
    dealt = rows.repartitionByRange(deal, F.desc("norm2"), F.asc("row")).sortWithinPartitions(F.desc("norm2")).withColumn("bucket", F.spark_partition_id())
    buckets = written(dealt, "negatives-buckets")
    sizes = {r["bucket"]: r["top"] for r in buckets.groupBy("bucket").agg(F.max("norm2").alias("top")).collect()}
    tops = [sizes.get(b, -1.0) for b in range(max(sizes, default=-1) + 1)]
    for b in range(len(tops) - 2, -1, -1):  # an empty bucket counts like the one after it
        tops[b] = max(tops[b], tops[b + 1])
    anchors = written(rows.filter(F.col("vec_id") % every == 0), "negatives-anchors")
    whole = anchors.select(F.col("row").alias("a"), F.lit(0).alias("w"), F.lit(_NONE).alias("low"), F.lit(_MOST).alias("high"))
    near = search(buckets, tops, anchors, whole, dim, kind, True, positives).select("a", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    asked = near.filter("positive_score >= 0").select("a", "w", _limit("positive_score", low, True).alias("low"), _limit("positive_score", high, False).alias("high"))
    found = search(buckets, tops, anchors, asked.filter("low <= high"), dim, kind, False, k)
    ids = anchors.select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id"))
    out = found.join(near, ["a", "w"]).join(ids, "a")
    forget(buckets)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, every: int = 100, positives: int = 5, k: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, v: whole numbers in doubles).

    Anchors are the rows whose vec_id is divisible by ``every``; an anchor's positives are its ``positives`` best other rows of the same label by inner product, ties to the
    smaller vec_id, and its negatives for each the ``k`` best rows of other labels whose score is ``low`` to ``high`` percent of the positive's. Fewer rows than asked for are all
    returned; a positive of negative score has no window. Rows without a vec_id, label or vector, or with a null or non-finite component, take no part; vectors of
    other lengths don't meet, and there is a search for each length. Rows that repeat a vec_id are rows of their own. Scores are exact; beyond 64 bits they count
    as the largest. Other columns are ignored.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<double>").alias("v")).dropna()
    kept = kept.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    held = written(kept.withColumns({"row": F.monotonically_increasing_id(), "norm2": norm2, "d": F.size("v")}), "negatives-rows")
    lengths = held.groupBy("d").agg(F.count("*").alias("n"), F.max("norm2").alias("most")).orderBy("d").collect()
    out = None
    for r in lengths:
        found = _mine(held.filter(F.col("d") == r["d"]).drop("d"), r["d"], r["n"], r["most"], every, positives, k, low, high)
        out = found if out is None else out.unionByName(found)
    nothing = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], nothing) if out is None else out
