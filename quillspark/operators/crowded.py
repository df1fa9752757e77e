"""Page-local matching on pages of any number of entries: the passes of ``spatial`` as joins on a grid and a matching in rounds.

Both passes take edges between entries in a fixed order and keep each whose two ends are still free: limit pairs by (first, second), depths by
(thread, distance, depth). An edge is settled once no earlier edge at its ends is open, so all edges that are first at both ends are taken
together, and what they touch is dropped. Edges are dealt into blocks of the order, and a block settles in one go all that other blocks' open edges don't
reach; so rounds follow how often a chain of dependent edges passes from block to block, not its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import js
from quillspark.operators.drawing import decimal_places
from quillspark.operators.spatial import PAGE, _pair, _plain, pair_possible
from quillspark.session import ship
from quillspark.sources.snapshots import stored, work_folder

#: Numbers of first ends in a block. Rounds beyond which the matching gives up; each settles one edge a page at least.
BLOCK, MOST_ROUNDS = 4096, 10_000
_ORDER = ("k1", "k2", "k3")
#: A page's key as one text, as pages without a number are one page too.
_KEY = "page_key"


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Settle the edges of blocks, one after another in their order; blocked ones wait for another block, and so do those after them at the same ends."""
    at, used, unsure = None, set(), set()
    for edges in batches:
        out = []
        for key, block, u, v, blocked in zip(*(edges[c].tolist() for c in (_KEY, "block", "u", "v", "blocked")), strict=True):
            if at != (key, block):
                at, used, unsure = (key, block), set(), set()
            if u in used or v in used:
                out.append("dropped")
            elif blocked or u in unsure or v in unsure:
                out.append("open")
                unsure |= {u, v}
            else:
                out.append("taken")
                used |= {u, v}
        yield edges.assign(state=out)


def matching(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edges (page_key, k1, k2, k3, u, v) of each page whose ends are free when they are taken in order of k1, k2, k3, which no two share.

    A task holds the edges of a block.
    """
    ship(edges.sparkSession)
    folder = work_folder(edges.sparkSession)
    keys = (_KEY,)
    open_ = stored(edges.select(*keys, *_ORDER, "u", "v", F.floor(F.col("k1") / block).alias("block")), f"{folder}/0")
    order = F.struct(*_ORDER)
    schema = open_.withColumns({"blocked": F.lit(True), "state": F.lit("")}).schema

    def settle(judged: DataFrame) -> DataFrame:
        return judged.repartition(*keys, "block").sortWithinPartitions(*keys, "block", *_ORDER).mapInPandas(_settled, schema)

    # a page of one block is settled in one go
    many = stored(open_.groupBy(*keys).agg(F.min("block").alias("a"), F.max("block").alias("b")).filter("a < b").select(*keys), f"{folder}/many")
    alone = stored(settle(open_.join(many, [*keys], "left_anti").withColumn("blocked", F.lit(False)).select(*schema.names[:-1])), f"{folder}/alone")
    taken = alone.filter("state = 'taken'").select(*keys, *_ORDER, "u", "v")
    open_ = open_.join(many, [*keys], "left_semi").select(*open_.columns)
    for n in range(1, MOST_ROUNDS):
        if open_.isEmpty():
            return taken
        ends = open_.select(*keys, F.explode(F.array("u", "v")).alias("x"), "block", order.alias("o"))
        first = ends.groupBy(*keys, "x", "block").agg(F.min("o").alias("m"))
        # the first edge of each block at an end; the two first blocks tell every block the first edge of others
        two = first.groupBy(*keys, "x").agg(F.slice(F.array_sort(F.collect_list(F.struct("m", "block"))), 1, 2).alias("two"))
        other = first.join(two, [*keys, "x"]).select(*keys, "x", "block", F.when(F.col("two")[0]["block"] == F.col("block"), F.get("two", F.lit(1))["m"]).otherwise(F.col("two")[0]["m"]).alias("other"))
        at = lambda end: other.select(*keys, F.col("x").alias(end), "block", F.col("other").alias(f"other_{end}"))  # noqa: B023, E731
        judged = open_.join(at("u"), [*keys, "u", "block"]).join(at("v"), [*keys, "v", "block"])
        judged = judged.withColumn("blocked", F.coalesce(F.col("other_u") < order, F.lit(False)) | F.coalesce(F.col("other_v") < order, F.lit(False))).select(*[f.name for f in schema][:-1])
        after = stored(settle(judged), f"{folder}/{n}-settled")
        new = after.filter("state = 'taken'").select(*keys, *_ORDER, "u", "v")
        used = new.select(*keys, F.explode(F.array("u", "v")).alias("x"))
        rest = after.filter("state = 'open'").select(*open_.columns)
        for end in ("u", "v"):
            rest = rest.join(used.withColumnRenamed("x", end), [*keys, end], "left_anti")
        open_ = stored(rest.select(*open_.columns), f"{folder}/{n}-open")
        taken = taken.unionByName(new)
    raise RuntimeError("the matching did not settle")


def _cells(low: Column, high: Column, size: Column) -> Column:
    """Numbers of the cells of ``size`` that an interval meets, a little wider than it is."""
    slack = (F.abs(low) + F.abs(high)) * 1e-9 + 1e-9
    return F.sequence(F.floor((low - slack) / size), F.floor((high + slack) / size))


def _grid(rows: DataFrame, x: tuple[Column, Column], y: tuple[Column, Column], size: DataFrame) -> DataFrame:
    """rows with a row for each cell (cx, cy) that their box x, y meets, and its first cells fx, fy. size: page_key, gx, gy."""
    with_size = rows.join(size, _KEY)
    xs, ys = _cells(*x, F.col("gx")), _cells(*y, F.col("gy"))
    boxed = with_size.withColumns({"_xs": xs, "_ys": ys}).withColumns({"fx": F.col("_xs")[0], "fy": F.col("_ys")[0]})
    return boxed.withColumn("cx", F.explode("_xs")).withColumn("cy", F.explode("_ys")).drop("_xs", "_ys", "gx", "gy")


def _finite(box: Column) -> Column:
    ok = F.lit(True)
    for k in ("x", "y", "width", "height"):
        ok = ok & (F.abs(box[k]) < float("inf")) & ~F.isnan(box[k])
    return ok


def _key() -> Column:
    return F.to_json(F.struct(*PAGE)).alias(_KEY)


def limit_pairs(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """What :func:`spatial.limit_pairs` gives, for pages of any size. Boxes meet by a grid of the page's mean box, so a crowded spot costs its own pairs only.

    Entries whose boxes are not finite make no pair.
    """
    text = js.trim(F.col("text"))
    rows = entries.filter(_plain(F.struct("*")) & _finite(F.col("bbox")) & (F.col("bbox.width") > 0)).select(*PAGE, _key(), F.struct("seq", "nominal", "unit", "bbox", "confidence", "source", text.alias("original_text"), decimal_places(text).alias("places")).alias("e"))
    rows = stored(rows.filter(F.col("e.places") > 0), f"{work_folder(entries.sparkSession)}/dimensions")
    sides = ("x", "y", "width", "height")
    flat = rows.select(_KEY, F.col("e.seq").cast("long").alias("seq"), F.col("e.places").alias("places"), *[F.col(f"e.bbox.{k}").alias(k) for k in sides])
    size = flat.groupBy(_KEY).agg(F.avg("width").alias("gx"), F.greatest(3 * F.avg(F.abs("height")), F.lit(1e-6)).alias("gy"))
    middle, reach = F.col("y") + F.col("height") / 2, 1.5 * F.abs("height")
    cells = _grid(flat, (F.col("x"), F.col("x") + F.col("width")), (middle - reach, middle + reach), size)
    left, right = (cells.select(_KEY, "cx", "cy", "places", *[F.col(k).alias(f"{n}_{k}") for k in ("seq", "fx", "fy", *sides)]) for n in "ab")
    # a pair counts in one of the cells in which it meets
    once = (F.col("cx") == F.greatest("a_fx", "b_fx")) & (F.col("cy") == F.greatest("a_fy", "b_fy"))
    one, two = (F.struct(F.struct(*[F.col(f"{n}_{k}").alias(k) for k in sides]).alias("bbox"), F.col("places").alias("places")) for n in "ab")
    met = left.join(right, [_KEY, "cx", "cy", "places"]).filter((F.col("a_seq") < F.col("b_seq")) & once & pair_possible(one, two))
    first, second = F.col("a_seq"), F.col("b_seq")
    edges = met.select(_KEY, first.alias("k1"), F.lit(0.0).alias("k2"), second.alias("k3"), first.alias("u"), second.alias("v"))
    found = matching(edges, block)
    own = lambda n, key, *more: rows.select(_KEY, *more, F.col("e").alias(n), F.col("e.seq").cast("long").alias(key))
    both = found.select(_KEY, "u", "v").join(own("a", "u", *PAGE), [_KEY, "u"]).join(own("b", "v"), [_KEY, "v"])
    a, b = F.col("a"), F.col("b")
    return both.select(*PAGE, a["seq"].alias("first_seq"), b["seq"].alias("second_seq"), *[v.alias(k) for k, v in _pair(a, b).items()])


def thread_depths(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """What :func:`spatial.thread_depths` gives, for pages of any size: each thread's depths within its limit are found by a grid of the page's mean limit.

    Entries whose boxes are not finite take no part.
    """
    boxed = entries.filter(F.col("category").isin("threads", "depths") & F.col("bbox").isNotNull() & _finite(F.col("bbox")))
    size = 4 * F.hypot("bbox.width", "bbox.height")
    rows = boxed.select(*PAGE, _key(), "category", F.col("seq").cast("long").alias("seq"), "bbox", "depth_type", "depth", F.when(size > 0, size).otherwise(120.0).alias("limit"))
    rows = stored(rows, f"{work_folder(entries.sparkSession)}/threads")
    threads, depths = rows.filter("category = 'threads'"), rows.filter("category = 'depths'")
    grid = threads.groupBy(_KEY).agg(F.avg("limit").alias("gx"), F.avg("limit").alias("gy"))
    def middles(part: DataFrame, *more: str) -> DataFrame:
        return part.select(_KEY, "seq", *more, (F.col("bbox.x") + F.col("bbox.width") / 2).alias("x"), (F.col("bbox.y") + F.col("bbox.height") / 2).alias("y"))

    x, y, limit = F.col("x"), F.col("y"), F.col("limit")
    around = _grid(middles(threads, "limit"), (x - limit, x + limit), (y - limit, y + limit), grid).select(_KEY, "cx", "cy", F.col("seq").alias("t"), x.alias("tx"), y.alias("ty"), "limit", "fx", "fy")
    at = _grid(middles(depths), (x, x), (y, y), grid).select(_KEY, "cx", "cy", F.col("seq").alias("d"), x.alias("dx"), y.alias("dy"), F.col("fx").alias("gx"), F.col("fy").alias("gy"))
    once = (F.col("cx") == F.greatest("fx", "gx")) & (F.col("cy") == F.greatest("fy", "gy"))
    met = around.join(at, [_KEY, "cx", "cy"]).filter(once).withColumn("far", F.hypot(F.col("tx") - F.col("dx"), F.col("ty") - F.col("dy"))).filter("far <= limit")
    edges = met.select(_KEY, F.col("t").alias("k1"), F.col("far").alias("k2"), F.col("d").alias("k3"), (2 * F.col("t")).alias("u"), (2 * F.col("d") + 1).alias("v"))
    found = matching(edges, block).select(_KEY, F.col("k1").alias("thread_seq"), F.col("k3").alias("depth_seq"))
    return found.join(depths.select(*PAGE, _KEY, F.col("seq").alias("depth_seq"), "depth_type", "depth"), [_KEY, "depth_seq"]).select(*PAGE, "thread_seq", "depth_seq", "depth_type", "depth")
