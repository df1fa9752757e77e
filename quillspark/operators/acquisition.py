"""Text acquisition: page routing between embedded and recognised text, boxes of polygons, joined regions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import js

#: Characters of embedded text that make recognition needless.
ENOUGH_CHARS = 20


def page_routes(items: DataFrame) -> DataFrame:
    """doc_id, page, chars, route: embedded text where a page has enough of it, else recognition."""
    chars = items.groupBy("doc_id", "page").agg(F.sum(F.length(js.trim(F.coalesce("text", F.lit(""))))).alias("chars"))
    return chars.withColumn("route", F.when(F.col("chars") >= ENOUGH_CHARS, "embedded").otherwise("ocr"))


def modes(routes: DataFrame) -> DataFrame:
    """doc_id, pages, pages_pdf, pages_ocr, mode."""
    out = routes.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("route") == "embedded").alias("pages_pdf"), F.count_if(F.col("route") == "ocr").alias("pages_ocr"))
    return out.withColumn("mode", F.when(F.col("pages_ocr") == 0, "embedded").when(F.col("pages_pdf") == 0, "ocr").otherwise("mixed"))


def routed(embedded: DataFrame, recognised: DataFrame) -> DataFrame:
    """Items of each page by its route: all embedded ones of pages with enough text, recognised ones of the others."""
    routes = page_routes(embedded).select("doc_id", "page", "route")
    own = embedded.join(routes.filter("route = 'embedded'"), ["doc_id", "page"], "left_semi")
    return own.unionByName(recognised.join(routes.filter("route = 'embedded'"), ["doc_id", "page"], "left_anti"))


def polygon_box(points: Column) -> Column:
    """Box of a flat list of x and y; fewer than two values give zeros. A lambda's variable holds the points, so that they and the box are computed once a row."""

    def box(p: Column) -> Column:
        xs, ys = F.filter(p, lambda _, i: i % 2 == 0), F.filter(p, lambda _, i: i % 2 == 1)
        x, y = F.array_min(xs), F.array_min(ys)
        return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("width"), (F.array_max(ys) - y).alias("height"))

    zeros = F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "width", "height")])
    return F.coalesce(F.get(F.transform(F.filter(F.array(points), lambda p: F.size(p) >= 2), box), F.lit(0)), zeros)


def mean_confidence(c: str) -> Column:
    """Aggregate: mean with missing ones as 0; 0 of none."""
    return F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))


def joined_text(seq: str, text: str, sep: str) -> Column:
    """Aggregate: texts in order of ``seq``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), sep)


def merged_regions(regions: DataFrame, by: list[str], box: str, confidence: str, **more: Column) -> DataFrame:
    """by, x, y, width, height, confidence, regions and further aggregates: each group's regions as one, within the box of all of them."""
    left, top = F.min(f"{box}.x"), F.min(f"{box}.y")
    right, bottom = F.max(F.col(f"{box}.x") + F.col(f"{box}.width")), F.max(F.col(f"{box}.y") + F.col(f"{box}.height"))
    boxes = {"x": left, "y": top, "width": right - left, "height": bottom - top}
    return regions.groupBy(*by).agg(*[c.alias(k) for k, c in (boxes | more).items()], mean_confidence(confidence).alias("confidence"), F.count("*").alias("regions"))


def recognised_item(text: Column, box: Column, confidence: Column, orientation: Column) -> Column:
    """A recognised item; missing text is empty, a missing confidence or orientation 0."""
    return F.struct(F.coalesce(text, F.lit("")).alias("text"), *[box[k].alias(k) for k in ("x", "y", "width", "height")], F.lit("paddleocr").alias("source"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.coalesce(orientation, F.lit(0)).alias("orientation"))


def mesh_view(points: DataFrame, model: str, mesh: str, fov: float) -> DataFrame:
    """model, meshes, center_x, center_y, center_z, max_dim (10 where it is 0) and the camera's distance of points (x, y, z), with ``fov`` in degrees."""
    sides = points.groupBy(model).agg(F.countDistinct(mesh).alias("meshes"), *[f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("low", F.min), ("high", F.max))])
    span = F.greatest(*[F.col(f"high_{k}") - F.col(f"low_{k}") for k in "xyz"])
    size = F.when(span == 0, 10.0).otherwise(span)
    centers = [((F.col(f"low_{k}") + F.col(f"high_{k}")) / 2).alias(f"center_{k}") for k in "xyz"]
    return sides.select(model, "meshes", *centers, size.alias("max_dim"), (F.abs(size / math.sin(math.radians(fov) / 2)) * 0.7).alias("distance"))


def embedded_item(transform_x: Column, transform_y: Column, width: Column, height: Column) -> Column:
    """Box of an embedded item: rounded to two places, height without sign."""
    return F.struct(js.rounded2(transform_x).alias("x"), js.rounded2(transform_y).alias("y"), js.rounded2(width).alias("width"), js.rounded2(F.abs(height)).alias("height"))
