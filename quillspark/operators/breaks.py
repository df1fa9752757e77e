"""Page breaks of documents of any length: the fold of ``quotes.page_breaks`` as a scan over blocks.

What a block does to the place where it is entered is a step function: where the first break falls depends on the place, and from there on nothing
does. Such functions compose into one of the same form, with at most as many steps as rows fit on a page, so blocks are composed FAN at a time, level by
level, and the places are handed down again; then every block is folded from its own place. Neighbouring blocks are packed until they have SIZE rows, and documents
of no more rows are folded as they are. No task holds more than a block and SIZE rows or FAN functions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quillspark.session import ship
from quillspark.sources.snapshots import stored, work_folder

#: Functions composed in one task, and rows that blocks are packed up to.
FAN, SIZE = 1024, 1024
_STEPS = "key string, b long, above array<double>, pages array<long>, y array<double>, total double"
_ARROW = pa.schema([("key", pa.string()), ("b", pa.int64()), ("above", pa.list_(pa.float64())), ("pages", pa.list_(pa.int64())), ("y", pa.list_(pa.float64())), ("total", pa.float64())])

#: (thresholds, falling; pages; tops), and the sum of heights: entered above a threshold, the first such decides; entered below all, heights just add up.
Steps = tuple[list[float], list[int], list[float], float]


def steps(heights: np.ndarray, margin: float, bottom: float) -> Steps:
    """The function of a block of rows."""
    ends = np.cumsum(heights)
    n, ahead = len(heights), ends - heights
    pages, y = np.zeros(n, np.int64), np.zeros(n)
    following = np.maximum(np.searchsorted(ends, ahead + (bottom - margin), side="right"), np.arange(n) + 1)
    for i in range(n - 1, -1, -1):  # what a page that starts at row i comes to
        k = following[i]
        pages[i], y[i] = (1, margin + ends[-1] - ahead[i]) if k >= n else (1 + pages[k], y[k])
    above = bottom - ends
    first = np.append(True, heights[1:] > 0)[:n]  # a row without height breaks no later than the one before it
    reached = np.append(True, above[:-1] >= margin)[:n]  # no place is above the margin
    at = np.flatnonzero(first & reached)
    return above[at].tolist(), pages[at].tolist(), y[at].tolist(), float(ends[-1]) if n else 0.0


def applied(f: Steps, page: int, y: float) -> tuple[int, float]:
    for above, pages, top in zip(*f[:3], strict=True):
        if y > above:
            return page + pages, top
    return page, y + f[3]


def composed(f: Steps, g: Steps, margin: float) -> Steps:
    """``f``, then ``g``."""
    after = [applied(g, p, y) for p, y in zip(f[1], f[2], strict=True)]
    above, pages, tops = list(f[0]), [p for p, _ in after], [y for _, y in after]
    for t, p, y in zip(*g[:3], strict=True):
        if above and above[-1] < margin:
            break
        above.append(t - f[3])
        pages.append(p)
        tops.append(y)
    return above, pages, tops, f[3] + g[3]


def _functions(df: pd.DataFrame) -> list[Steps]:
    return [(list(a), [int(p) for p in ps], list(y), float(t)) for a, ps, y, t in zip(df["above"], df["pages"], df["y"], df["total"], strict=True)]


def _by_block(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a block one after another in one task, in their order."""
    return rows.repartition("key", "c").sortWithinPartitions("key", "c", F.asc_nulls_first("b"), *[F.asc_nulls_first(k) for k in columns])


def _folded(rows: DataFrame, margin: float, bottom: float, schema: StructType) -> DataFrame:
    """Page and top of rows that come block by block in their order, each block from its page and at; a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page, y = None, 1, margin
        for batch in batches:
            pages, tops = [], []
            for key, c, h, *start in zip(*(batch.column(k).to_pylist() for k in ("key", "c", "h", "page", "at")), strict=True):
                if last != (key, c):
                    last, (page, y) = (key, c), start
                if y + h > bottom:
                    page, y = page + 1, margin
                pages.append(page)
                tops.append(y)
                y += h
            own = [batch.column(f"c{i}") for i in range(len(schema) - 2)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(pages, pa.int32()), pa.array(tops, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def placed(rows: DataFrame, doc: str, block: Column, order: list[str], height: str, margin: float, bottom: float, fan: int = FAN, size: int = SIZE) -> DataFrame:
    """The columns of ``rows``, page and top of every row of ``rows`` in its document.

    A document's rows follow ``block``, a whole number that never falls along the order, and within it the columns of ``order``. The heights of a block are
    held by one task, with those before it that have less than ``size`` rows together. Null or negative heights count as 0; a null document is one too, and
    so is a null block, which comes first. Rows equal in ``order`` are taken by height. Sums of heights have to be exact in double precision, as whole points
    are; columns page and top of ``rows`` are replaced, and its columns have to be ones that can be ordered.
    """
    ship(rows.sparkSession)
    folder = work_folder(rows.sparkSession)
    own = rows.drop("page", "top")
    schema = StructType([*own.schema.fields, StructField("page", IntegerType()), StructField("top", DoubleType())])
    high = F.greatest(F.coalesce(F.col(height).cast("double"), F.lit(0.0)), F.lit(0.0))
    key = F.to_json(F.struct(F.col(doc).alias("d")))
    flat = own.select(key.alias("key"), block.cast("long").alias("b"), high.alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(own.columns)])
    ordered = [f"c{own.columns.index(c)}" for c in order]
    every = [*ordered, "h", *[f"c{i}" for i, c in enumerate(own.columns) if c not in order]]
    first = {"c": F.lit(0).cast("long"), "page": F.lit(1).cast("long"), "at": F.lit(margin).cast("double")}
    long_ = stored(flat.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > size).select("key"), f"{folder}/long")
    if long_.isEmpty():
        return _folded(_by_block(flat.withColumns(first), every), margin, bottom, schema)
    short = _folded(_by_block(flat.join(long_, "key", "left_anti").withColumns(first), every), margin, bottom, schema)
    flat = flat.join(long_, "key", "left_semi")
    before = Window.partitionBy("key").orderBy(F.asc_nulls_first("b")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    packed = flat.groupBy("key", "b").agg(F.count("*").alias("n")).select(F.col("key").alias("_key"), F.col("b").alias("_b"), F.floor((F.sum("n").over(before) - F.col("n")) / size).alias("c"))
    packed = stored(packed, f"{folder}/packed")
    dealt = flat.join(packed, (F.col("key") == F.col("_key")) & F.col("b").eqNullSafe(F.col("_b"))).drop("_key", "_b")
    last = packed.agg(F.max("c")).head()[0]

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heights = None, []
        for batch in chain(batches, [None]):
            found = []
            for key, c, h in [(None, None, 0.0)] if batch is None else zip(*(batch.column(k).to_pylist() for k in ("key", "c", "h")), strict=True):
                if at != (key, c):
                    if heights:
                        found.append((*at, *steps(np.array(heights), margin, bottom)))
                    at, heights = (key, c), []
                heights.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for f, v in zip(_ARROW, zip(*found, strict=True) if found else [[]] * len(_ARROW), strict=True)], schema=_ARROW)

    def joined(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("b")
        whole, *rest = _functions(df)
        for f in rest:
            whole = composed(whole, f, margin)
        return pd.DataFrame({"key": df["key"].iloc[:1].tolist(), "b": [int(df["parent"].iloc[0])], **{c: [v] for c, v in zip(("above", "pages", "y", "total"), whole, strict=True)}})

    def entered(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("b")
        page, y = int(df["page"].iloc[0]), float(df["at"].iloc[0])
        out = []
        for f in _functions(df):
            out.append((page, y))
            page, y = applied(f, page, y)
        return pd.DataFrame({"key": df["key"], "b": df["b"], "page": [p for p, _ in out], "at": [y for _, y in out]})

    parent = F.floor(F.col("b") / fan).cast("long").alias("parent")
    levels = [stored(_by_block(dealt.select("key", "c", "b", "h", *ordered), [*ordered, "h"]).mapInArrow(leaves, _STEPS), f"{folder}/functions-0")]
    while last >= fan:
        levels.append(stored(levels[-1].select("*", parent).groupBy("key", "parent").applyInPandas(joined, _STEPS), f"{folder}/functions-{len(levels)}"))
        last //= fan
    start = levels[-1].select("key", parent).distinct().select("key", "parent", F.lit(1).cast("long").alias("page"), F.lit(margin).cast("double").alias("at"))
    for level in reversed(levels):
        places = level.select("*", parent).join(start, ["key", "parent"]).groupBy("key", "parent").applyInPandas(entered, "key string, b long, page long, at double")
        start = places.withColumnRenamed("b", "parent")
    places = stored(places.withColumnRenamed("b", "c"), f"{folder}/places")
    return short.unionByName(_folded(_by_block(dealt.join(places, ["key", "c"]), every), margin, bottom, schema))
