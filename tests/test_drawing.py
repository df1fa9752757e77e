"""Classifier against hand-derived texts; spatial passes against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import display, spatial
from quillspark.operators.drawing import CATEGORIES, classify, classify_distinct, with_bbox

#: text, category, type, fields that are not null
GOLDEN = [
    ("1.122±.004", "dimensions", "linear_dimension", {"nominal": 1.122, "tolerance_type": "bilateral", "plus_tolerance": 0.004, "minus_tolerance": 0.004}),
    ("1.040 +/- .004", "dimensions", "linear_dimension", {"nominal": 1.04, "tolerance_type": "bilateral", "plus_tolerance": 0.004, "minus_tolerance": 0.004}),
    ("2.000 +.002/-.000", "dimensions", "linear_dimension", {"nominal": 2.0, "tolerance_type": "unilateral", "plus_tolerance": 0.002, "minus_tolerance": 0.0}),
    ("15.0 +0.1 -0.0", "dimensions", "linear_dimension", {"nominal": 15.0, "tolerance_type": "unilateral", "plus_tolerance": 0.1, "minus_tolerance": 0.0}),
    ("10.00/9.98", "dimensions", "limit_dimension", {"tolerance_type": "limit", "upper": 10.0, "lower": 9.98}),
    ("1-1/2", "dimensions", "fraction_dimension", {"nominal": 1.5, "unit": "in", "tolerance_type": "none"}),
    ("1/2", "dimensions", "fraction_dimension", {"nominal": 0.5, "unit": "in", "tolerance_type": "none"}),
    ("1/0", "dimensions", "fraction_dimension", {"nominal": math.inf, "unit": "in", "tolerance_type": "none"}),
    ("12 mm", "dimensions", "linear_dimension", {"nominal": 12.0, "unit": "mm", "tolerance_type": "none"}),
    ('.250"', "dimensions", "linear_dimension", {"nominal": 0.25, "unit": "in", "tolerance_type": "none"}),
    ("12", "unclassified", "unclassified", {"spec": "12"}),
    (".500/.498", "unclassified", "unclassified", {"spec": ".500/.498"}),
    ("304", "materials", "material", {"value_str": "304"}),
    ("Ø.375±.003", "diameters", "diameter", {"nominal": 0.375, "tolerance_type": "bilateral", "plus_tolerance": 0.003, "minus_tolerance": 0.003}),
    ("DIA .500", "diameters", "diameter", {"nominal": 0.5, "tolerance_type": "none"}),
    ("DIA. 250", "diameters", "diameter", {"nominal": 250.0, "tolerance_type": "none"}),
    ("DIA.250", "diameters", "diameter", {"nominal": 0.25, "tolerance_type": "none"}),
    ("O.250", "diameters", "diameter", {"nominal": 0.25, "tolerance_type": "none", "ocr_substitution": "O→Ø"}),
    ("O1", "diameters", "diameter", {"nominal": 1.0, "tolerance_type": "none", "ocr_substitution": "O→Ø"}),
    ("Ø.5 TYP", "diameters", "diameter", {"nominal": 0.5, "tolerance_type": "none"}),
    ("R.125 MAX", "radii", "radius", {"value_num": 0.125, "condition": "MAX"}),
    ("R.125±.005", "radii", "radius", {"value_num": 0.125}),
    ("SR 2.5", "radii", "spherical_radius", {"value_num": 2.5}),
    ("4X", "quantities", "feature_callout", {"quantity": 4.0}),
    ("4X10", "unclassified", "unclassified", {"spec": "4X10"}),
    ("2X .030 X 45°", "quantities", "feature_callout", {"quantity": 2.0, "feature": "chamfer", "size": 0.03, "angle": 45.0}),
    ("4X Ø.250 THRU", "quantities", "feature_callout", {"quantity": 4.0, "feature": "diameter", "size": 0.25, "remainder": "THRU"}),
    ("4X .250 INCH", "quantities", "feature_callout", {"quantity": 4.0, "size": 0.25, "unit": "in", "remainder": "CH"}),
    ("2X SR.5 mm DEEP", "quantities", "feature_callout", {"quantity": 2.0, "feature": "spherical_radius", "size": 0.5, "unit": "mm", "remainder": "DEEP"}),
    ("3X HOLES", "quantities", "feature_callout", {"quantity": 3.0, "remainder": "HOLES"}),
    ("QTY: 12", "quantities", "quantity", {"value_num": 12.0, "unit": "pcs", "spec": "QTY: 12"}),
    ("(4 PLACES)", "quantities", "quantity", {"value_num": 4.0, "unit": "pcs", "spec": "(4 PLACES)"}),
    ("1/4-20 UNC-2B", "threads", "thread", {"thread_system": "inch", "thread_nominal": "1/4", "threads_per_inch": 20.0, "series": "UNC", "class": "2B"}),
    ("4X M6x1.0-6H", "threads", "thread", {"thread_system": "metric", "nominal": 6.0, "pitch": 1.0, "class": "6H", "quantity": 4.0}),
    ("1/4-20 unc", "unclassified", "unclassified", {"spec": "1/4-20 unc"}),
    ("M8", "unclassified", "unclassified", {"spec": "M8"}),
    ("Ra 1.6", "finishes", "surface_roughness", {"value_str": "Ra 1.6"}),
    ("ULTRA 5", "finishes", "surface_roughness", {"value_str": "Ra 5"}),
    ("FINISH: HARD ANODIZE", "finishes", "finish", {"value_str": "HARD ANODIZE"}),
    ("FINISHES", "finishes", "finish", {"value_str": "ES"}),
    ("BASE PLATE", "finishes", "finish", {"value_str": "BASE PLATE"}),
    ("MATERIAL: 304 STAINLESS, PASSIVATED", "finishes", "finish", {"value_str": "MATERIAL: 304 STAINLESS, PASSIVATED"}),
    ("MATL: 6061-T6", "materials", "material", {"value_str": "6061-T6"}),
    ("6061-T6", "materials", "material", {"value_str": "6061-T6"}),
    ("PN-6061", "unclassified", "unclassified", {"spec": "PN-6061"}),
    ("SIZE: 2.0 x 1.0", "specifications", "specification", {"label": "SIZE", "value_str": "2.0 x 1.0"}),
    ("THRU ALL", "depths", "depth", {"depth_type": "thru"}),
    ("DEPTH .500", "depths", "depth", {"depth_type": "blind", "depth": 0.5}),
    (".500 DEEP", "depths", "depth", {"depth_type": "blind", "depth": 0.5}),
    ("0.5 THRU", "unclassified", "unclassified", {"spec": "0.5 THRU"}),
    ("SEE NOTE 3", "notes", "note_prefix", {"spec": "SEE NOTE 3"}),
    ("1. Deburr all edges", "notes", "numbered_note", {"spec": "1. Deburr all edges"}),
    ("BREAK SHARP EDGES", "notes", "note_phrase", {"spec": "break sharp edges"}),
    ("TYPE III", "notes", "note_phrase", {"spec": "typ"}),
    (" ", "unclassified", "unclassified", {"spec": ""}),
    (None, "unclassified", "unclassified", {"spec": ""}),
]
ITEM = "doc_id long, seq int, page int, text string, x double, y double, width double, height double, source string, confidence double"


def test_golden_texts(spark):
    rows = classify(spark.createDataFrame([(i, g[0]) for i, g in enumerate(GOLDEN)], "i int, text string")).orderBy("i").collect()
    for r, (t, category, kind, fields) in zip(rows, GOLDEN, strict=True):
        got = {k: v for k, v in r.asDict().items() if v is not None and k not in ("i", "text", "category", "type")}
        assert (r["category"], r["type"], got) == (category, kind, fields), t
        assert r["category"] in CATEGORIES


def entries(spark, items):
    return with_bbox(classify(spark.createDataFrame(items, ITEM)))


def pair_by_loops(items):
    def fits(a, b):
        narrow, height = min(a[6], b[6]), (a[7] + b[7]) / 2
        overlap = max(0, min(a[4] + a[6], b[4] + b[6]) - max(a[4], b[4]))
        gap = abs((a[5] + a[7] / 2) - (b[5] + b[7] / 2))
        places = [len(x[3].split(".")[1]) for x in (a, b)]
        return a[0] == b[0] and a[2] == b[2] and narrow > 0 and overlap / narrow >= 0.5 and 0.5 * height <= gap <= 3 * height and places[0] == places[1] > 0

    used, out = set(), set()
    for i, a in enumerate(items):
        for j in range(i + 1, len(items)):
            if i not in used and j not in used and fits(a, items[j]):
                used |= {i, j}
                out.add((a[0], a[2], a[1], items[j][1]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_limit_pairs_equal_loops(spark, seed):
    rng = random.Random(seed)
    items = [(d, s, rng.randint(1, 2), rng.choice([".480", ".478", "1.25", "2.5", ".5"]), float(rng.randint(0, 3) * 8), float(rng.randint(0, 12) * 6), 30.0, 10.0, "ocr", rng.choice([None, 0.9])) for d in range(40) for s in range(rng.randint(1, 9))]
    got = spatial.limit_pairs(entries(spark, items)).collect()
    assert {(r["doc_id"], r["page"], r["first_seq"], r["second_seq"]) for r in got} == pair_by_loops(items) and got
    seen = [(r["doc_id"], s) for r in got for s in (r["first_seq"], r["second_seq"])]
    assert len(seen) == len(set(seen)) and all(r["upper_limit"] >= r["lower_limit"] for r in got)


def test_limit_pair_cases(spark):
    a = (1, 1, 1, ".480", 100.0, 200.0, 30.0, 10.0, "ocr", 0.9)
    second = lambda d, **new: tuple({**dict(zip(("doc_id", "seq", "page", "text", "x", "y", "width", "height", "source", "confidence"), (d, 2, 1, ".478", 100.0, 212.0, 30.0, 10.0, "ocr", None), strict=True)), **new}.values())
    first = lambda d: (d, *a[1:])
    items = [x for d, new in enumerate([{}, {"page": 2}, {"text": ".48"}, {"y": 204.0}, {"y": 231.0}, {"x": 116.0}, {"x": None}]) for x in (first(d), second(d, **new))]
    got = spatial.limit_pairs(entries(spark, items)).collect()
    assert [(r["doc_id"], r["upper_limit"], r["lower_limit"], r["confidence"], tuple(r["bbox"]), r["members"]) for r in got] == [(0, 0.48, 0.478, 0.9, (100.0, 200.0, 30.0, 22.0), [".480", ".478"])]


def depths_by_loops(items):
    out, used = set(), set()
    threads, depths = ([x for x in items if x[3].startswith("M6")], [x for x in items if not x[3].startswith("M6")])
    for t in threads:
        limit, best = 4 * math.hypot(t[6], t[7]) or 120, None
        for d in depths:
            dist = math.hypot(t[4] + t[6] / 2 - d[4] - d[6] / 2, t[5] + t[7] / 2 - d[5] - d[7] / 2)
            if d not in used and (d[0], d[2]) == (t[0], t[2]) and dist <= limit and (best is None or dist < best[0]):
                best = (dist, d)
        if best:
            used.add(best[1])
            out.add((t[0], t[2], t[1], best[1][1]))
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_thread_depths_equal_loops(spark, seed):
    rng = random.Random(seed)
    size = lambda: (0.0, 0.0) if rng.random() < 0.2 else (30.0, 10.0)
    items = [(d, s, rng.randint(1, 2), rng.choice(["M6x1", "M6x1", "THRU", ".5 DEEP"]), float(rng.randint(0, 20) * 10), float(rng.randint(0, 20) * 10), *size(), "ocr", None) for d in range(40) for s in range(rng.randint(1, 10))]
    e = entries(spark, items)
    got = spatial.thread_depths(e).collect()
    assert {(r["doc_id"], r["page"], r["thread_seq"], r["depth_seq"]) for r in got} == depths_by_loops(items) and got
    parsed = spatial.parse_drawing(spark.createDataFrame(items, ITEM))
    assert parsed.filter("category = 'depths'").count() + len(got) == sum(not x[3].startswith("M6") for x in items)
    assert parsed.filter("category = 'threads' and depth_type is not null").count() == len(got)


def test_display_records(spark):
    items = [(1, k, 1, t, None, None, None, None, "pdf", None) for k, t in enumerate([".5±.004", "10.00/9.98", "M6x1", "4X Ø.250 THRU", "Ø.5", "zzz", "QTY: 3", "R2 MAX", "DEPTH 1"])]
    rows = display.records(entries(spark, items)).orderBy("seq").collect()
    assert [r["primary"] for r in rows] == ["0.5", "—", "M6 x 1", "4X", "Ø0.5", "zzz", "3 pcs", "2", None]
    assert [t["value"] for t in rows[0]["tags"]] == ["±0.004", "linear_dimension"]
    assert rows[1]["tags"][0]["value"] == "10 / 9.98"
    assert [(t["label"], t["value"]) for t in rows[3]["tags"]] == [("Feature", "diameter"), ("Size", "0.25"), ("Angle", "—"), ("Remainder", "THRU")]
    assert rows[7]["tags"][1]["value"] == "MAX"


def test_parsed_drawing_has_pairs_and_sections(spark):
    items = [(1, 1, 1, ".480", 100.0, 200.0, 30.0, 10.0, "ocr", 0.9), (1, 2, 1, ".478", 100.0, 212.0, 30.0, 10.0, "ocr", None), (1, 3, 1, "M6x1", 0.0, 0.0, 30.0, 10.0, "ocr", None), (1, 4, 1, "THRU", 5.0, 5.0, 30.0, 10.0, "ocr", None), (1, 5, 1, None, None, None, None, None, "ocr", None), (2, 1, None, "THRU", None, None, None, None, "pdf", None)]
    parsed = spatial.parse_drawing(spark.createDataFrame(items, ITEM))
    rows = {(r["doc_id"], r["category"], r["seq"]): r for r in parsed.collect()}
    assert sorted((d, c) for d, c, _ in rows) == [(1, "dimensions"), (1, "dimensions"), (1, "possible_limit_dimensions"), (1, "threads"), (1, "unclassified"), (2, "depths")]
    pair = rows[1, "possible_limit_dimensions", 1]
    assert (pair["upper"], pair["lower"], pair["members"], pair["status"], pair["type"]) == (0.48, 0.478, [".480", ".478"], "needs_confirmation", "possible_limit_dimension")
    assert rows[1, "threads", 3]["depth_type"] == "thru"
    counts = {r["category"]: r["n"] for r in spatial.section_counts(parsed, CATEGORIES).collect()}
    assert len(counts) == 12 and counts["dimensions"] == 2 and counts["possible_limit_dimensions"] == 1 and counts["radii"] == 0
    shown = {(r["doc_id"], r["category"]): r for r in display.records(parsed).collect()}
    assert shown[1, "possible_limit_dimensions"]["primary"] == "0.48 / 0.478" and [t["value"] for t in shown[1, "possible_limit_dimensions"]["tags"]] == ["needs_confirmation", ".480 / .478"]
    assert spatial.parse_drawing(spark.createDataFrame([], ITEM)).count() == 0


def test_a_hot_text_is_split_among_tasks(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "65536",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32768",
    }
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        items = spark.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, "THRU").otherwise(F.concat(F.lit("R"), (F.col("id") % 500).cast("string"))).alias("text"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
        found = classify_distinct(items)
        rows = found.collect()
        assert len(rows) == 60_000 and {r["category"] for r in rows if r["text"] == "THRU"} == {"depths"}
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
