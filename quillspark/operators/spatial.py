"""Page-local matching of parsed drawing entries: possible limit pairs, and depths to threads.

Both are greedy and depend on the order of items, so each page's entries are sorted by ``seq`` and folded. A page's items lie in one row: pages are
bounded by what fits on a sheet, and no condition reaches across pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import js
from quillspark.operators.drawing import classify_distinct, decimal_places, with_bbox

PAGE = ("doc_id", "page")


def _entries(rows: DataFrame) -> DataFrame:
    """A row for each page with its entries, in order of ``seq``."""
    rest = [c for c in rows.columns if c not in ("seq", *PAGE)]
    return rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("seq", *rest))).alias("_all"))


def pair_possible(a: Column, b: Column) -> Column:
    """Whether two plain dimensions may be a stacked pair: aligned in x, at most a few lines apart, and equally precise."""
    x, y = a["bbox"], b["bbox"]
    narrow = F.least(x["width"], y["width"])
    overlap = F.greatest(F.lit(0.0), F.least(x["x"] + x["width"], y["x"] + y["width"]) - F.greatest(x["x"], y["x"]))
    height = (x["height"] + y["height"]) / 2
    gap = F.abs((x["y"] + x["height"] / 2) - (y["y"] + y["height"] / 2))
    ok = (narrow > 0) & (height > 0) & (a["places"] > 0) & (a["places"] == b["places"]) & (gap >= 0.5 * height) & (gap <= 3 * height)
    return F.coalesce(ok & (overlap >= 0.5 * narrow), F.lit(False))


def merged_box(x: Column, y: Column) -> Column:
    left, top = F.least(x["x"], y["x"]), F.least(x["y"], y["y"])
    right, bottom = F.greatest(x["x"] + x["width"], y["x"] + y["width"]), F.greatest(x["y"] + x["height"], y["y"] + y["height"])
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def _plain(e: Column) -> Column:
    finite = e["nominal"].isNotNull() & ~F.isnan(e["nominal"]) & (F.abs(e["nominal"]) != float("inf"))
    return (e["category"] == "dimensions") & (e["type"] == "linear_dimension") & (e["tolerance_type"] == "none") & finite & e["bbox"].isNotNull()


def _candidates(entries: Column) -> Column:
    """The plain dimensions among a page's entries with what pairs are judged by."""
    with_places = lambda e: F.struct(*[e[k].alias(k) for k in ("seq", "nominal", "unit", "bbox", "confidence", "source")], js.trim(e["text"]).alias("original_text"), decimal_places(js.trim(e["text"])).alias("places"))
    return F.transform(F.filter(entries, _plain), with_places)


def _pairs(items: Column) -> Column:
    """array of struct(i, j): in order, an item that is still free is joined with the first later free one that fits."""
    kind = "array<struct<i:int,j:int>>"
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("pairs"))

    def step(acc: Column, i: Column) -> Column:
        later = F.filter(F.sequence(i + 1, F.greatest(i + 1, F.size(items) - 1)), lambda j: (j < F.size(items)) & ~F.array_contains(acc["used"], j) & pair_possible(F.get(items, i), F.get(items, j)))
        j = F.get(later, F.lit(0))
        taken = F.struct(F.concat(acc["used"], F.array(i, j)).alias("used"), F.array_append(acc["pairs"], F.struct(i.alias("i"), j.alias("j"))).alias("pairs"))
        return F.when(F.array_contains(acc["used"], i) | j.isNull(), acc).otherwise(taken)

    return F.when(F.size(items) > 1, F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), start, step, lambda acc: acc["pairs"])).otherwise(F.array().cast(kind))


def _pair(a: Column, b: Column) -> dict[str, Column]:
    return {
        "upper_limit": F.greatest(a["nominal"], b["nominal"]),
        "lower_limit": F.least(a["nominal"], b["nominal"]),
        "unit": F.coalesce(a["unit"], b["unit"]),
        "members": F.array(a["original_text"], b["original_text"]),
        "bbox": merged_box(a["bbox"], b["bbox"]),
        "confidence": F.least(F.coalesce(a["confidence"], F.lit(1.0)), F.coalesce(b["confidence"], F.lit(1.0))),
        "source": F.coalesce(a["source"], b["source"]),
        "status": F.lit("needs_confirmation"),
    }


def limit_pairs(entries: DataFrame) -> DataFrame:
    """Pairs of plain dimensions (doc_id, page, first_seq, second_seq, upper_limit, lower_limit, unit, members, bbox, confidence, source, status).

    Each entry takes part in one pair at most.
    """
    plain = entries.filter(_plain(F.struct("*"))).select(*PAGE, "seq", "text", "bbox", "source", "confidence", "category", "type", "nominal", "unit", "tolerance_type")
    pages = _entries(plain).select(*PAGE, _candidates(F.col("_all")).alias("items")).filter(F.size("items") > 1)
    found = pages.select(*PAGE, "items", F.explode(_pairs(F.col("items"))).alias("p")).select(*PAGE, F.col("items")[F.col("p.i")].alias("a"), F.col("items")[F.col("p.j")].alias("b"))
    a, b = F.col("a"), F.col("b")
    return found.select(*PAGE, a["seq"].alias("first_seq"), b["seq"].alias("second_seq"), *[v.alias(k) for k, v in _pair(a, b).items()])


def _near(a: Column, b: Column) -> Column:
    """Distance of two boxes' middles."""
    middle = lambda c, side, size: c[side] + c[size] / 2
    return F.hypot(middle(a, "x", "width") - middle(b, "x", "width"), middle(a, "y", "height") - middle(b, "y", "height"))


def _given(threads: Column, depths: Column) -> Column:
    """array of struct(t, i): the depth (its place in ``depths``) given to the thread of seq t."""
    kind = "array<struct<t:bigint,i:int>>"

    def step(acc: Column, t: Column) -> Column:
        size = 4 * F.hypot(t["bbox"]["width"], t["bbox"]["height"])
        limit = F.when(size > 0, size).otherwise(120.0)
        near = F.transform(depths, lambda d, i: F.struct(_near(t["bbox"], d["bbox"]).alias("d"), i.alias("i")))
        best = F.array_min(F.filter(near, lambda c: ~F.array_contains(acc["used"], c["i"]) & (c["d"] <= limit)))
        taken = F.struct(F.array_append(acc["used"], best["i"]).alias("used"), F.array_append(acc["pairs"], F.struct(t["seq"].cast("bigint").alias("t"), best["i"].alias("i"))).alias("pairs"))
        return F.when(best.isNull(), acc).otherwise(taken)

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast(kind).alias("pairs"))
    return F.when((F.size(threads) > 0) & (F.size(depths) > 0), F.aggregate(threads, start, step, lambda acc: acc["pairs"])).otherwise(F.array().cast(kind))


def _boxed(entries: Column, category: str) -> Column:
    return F.filter(entries, lambda e: (e["category"] == category) & e["bbox"].isNotNull())


def thread_depths(entries: DataFrame) -> DataFrame:
    """doc_id, page, thread_seq, depth_seq, depth_type, depth: the depth given to each thread that gets one.

    Threads choose in order, each the nearest depth of its page that is free and within four diagonals of its box (120 if that is 0); of equally near
    ones the first.
    """
    boxed = entries.filter(F.col("category").isin("threads", "depths") & F.col("bbox").isNotNull()).select(*PAGE, "seq", "category", "bbox", "depth_type", "depth")
    both = _entries(boxed).select(*PAGE, _boxed(F.col("_all"), "threads").alias("threads"), _boxed(F.col("_all"), "depths").alias("depths")).filter((F.size("threads") > 0) & (F.size("depths") > 0))
    found = both.select(*PAGE, "depths", F.explode(_given(F.col("threads"), F.col("depths"))).alias("p"))
    d = F.col("depths")[F.col("p.i")]
    return found.select(*PAGE, F.col("p.t").alias("thread_seq"), d["seq"].cast("bigint").alias("depth_seq"), d["depth_type"].alias("depth_type"), d["depth"].alias("depth"))


def parse_drawing(items: DataFrame) -> DataFrame:
    """Entries of ``items`` (doc_id, seq, page, text, x, y, width, height, source, confidence) after both passes: items' columns, category, type, FIELDS, bbox, members, status.

    Threads have the depth given to them, and depths so used are left out. Possible limit pairs are entries of category possible_limit_dimensions
    with upper, lower, members and status, and the first member's seq; their members stay. One classification of each distinct text and one shuffle by page.
    """
    entries = with_bbox(classify_distinct(items)).withColumns({"members": F.lit(None).cast("array<string>"), "status": F.lit(None).cast("string")})
    kinds = {f.name: f.dataType for f in entries.schema.fields if f.name not in PAGE}
    pages = _entries(entries).withColumns({"_items": _candidates(F.col("_all")), "_threads": _boxed(F.col("_all"), "threads"), "_depths": _boxed(F.col("_all"), "depths")})
    pages = pages.withColumns({"_pairs": _pairs(F.col("_items")), "_given": _given(F.col("_threads"), F.col("_depths"))})
    pages = pages.withColumn("_used", F.transform("_given", lambda g: F.struct(g["t"].alias("t"), F.get("_depths", g["i"]).alias("d"))))

    def entry(e: Column) -> Column:
        own = F.get(F.filter("_used", lambda u: u["t"] == e["seq"]), F.lit(0))
        return F.when(own.isNull(), e).otherwise(e.withField("depth_type", own["d"]["depth_type"]).withField("depth", own["d"]["depth"]))

    def pair(p: Column) -> Column:
        a, b = F.get("_items", p["i"]), F.get("_items", p["j"])
        made = _pair(a, b)
        made |= {"seq": a["seq"], "category": F.lit("possible_limit_dimensions"), "type": F.lit("possible_limit_dimension"), "upper": made.pop("upper_limit"), "lower": made.pop("lower_limit")}
        return F.struct(*[(made[k] if k in made else F.lit(None).cast(t)).alias(k) for k, t in kinds.items()])

    order = ["seq", *[k for k in kinds if k != "seq"]]
    left = F.transform(F.filter("_all", lambda e: ~F.exists("_used", lambda u: u["d"]["seq"] == e["seq"])), entry)
    same = lambda x: F.struct(*[x[k].alias(k) for k in order])
    whole = F.concat(F.transform(left, same), F.transform(F.transform("_pairs", pair), same))
    return pages.select(*PAGE, F.explode(whole).alias("e")).select(*[F.col(c) if c in PAGE else F.col(f"e.{c}") for c in entries.columns])


def section_counts(entries: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """category, n: how many entries of :func:`parse_drawing` each section of a fixed list has, also none."""
    found = entries.groupBy("category").agg(F.count("*").alias("n"))
    names = entries.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return names.join(found, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def merged_section(entries: DataFrame, *categories: str) -> DataFrame:
    """Entries of several categories as one list of each document: place, by the order of ``categories`` and then of items."""
    rank = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "seq"))
    return entries.filter(F.col("category").isin(*categories)).withColumn("place", place)
