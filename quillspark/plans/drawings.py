"""Queries over drawing text items, which are computed from line items by whole-number arithmetic.

The SQL side knows the computed shapes and states, for each, what the classifier has to make of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import acquisition as A
from quillspark.operators import crowded, display, spatial
from quillspark.operators.drawing import CATEGORIES, FIELDS, classify_distinct, with_bbox
from quillspark.plans.registry import register
from quillspark.sources.tables import SHAPES, dealt, drawing_items, extension, table

#: Category and type of each computed shape, in the order of SHAPES. Fixed values for the SQL side, and so are the tables below.
_CATEGORIES = ("dimensions", "dimensions", "diameters", "radii", "quantities", "threads", "threads", "depths", "depths", "quantities", "finishes", "materials", "specifications", "notes", "notes", "unclassified", "dimensions", "dimensions")
_TYPES = ("linear_dimension", "linear_dimension", "diameter", "radius", "feature_callout", "thread", "thread", "depth", "depth", "quantity", "finish", "material", "specification", "note_prefix", "numbered_note", "unclassified", "limit_dimension", "fraction_dimension")
_PART, _WHOLE, _SMALL = "('0.' || d)::double", "(n || '.' || d)::double", "('0.00' || k)::double"
#: Of each field the shapes that have it and what it holds there, in terms of n, d and k.
_VALUES = {
    "nominal": {0: _PART, 1: _WHOLE, 2: _PART, 6: "n::double", 17: "1 + k / 2"},
    "value_num": {3: _PART, 9: "n::double"},
    "value_str": {10: "'CODE ' || n", 11: "'6061-T6'", 12: "n || ' x ' || k"},
    "unit": {9: "'pcs'", 17: "'in'"},
    "tolerance_type": {0: "'none'", 1: "'bilateral'", 2: "'bilateral'", 16: "'limit'", 17: "'none'"},
    "plus_tolerance": {1: _SMALL, 2: _SMALL},
    "minus_tolerance": {1: _SMALL, 2: _SMALL},
    "upper": {16: _WHOLE},
    "lower": {16: _WHOLE},
    "condition": {3: "'MAX'"},
    "quantity": {4: "k::double"},
    "feature": {4: "'diameter'"},
    "size": {4: _PART},
    "remainder": {4: "'THRU'"},
    "thread_system": {5: "'inch'", 6: "'metric'"},
    "thread_nominal": {5: "n || '/' || k"},
    "threads_per_inch": {5: "20.0::double"},
    "pitch": {6: "('1.' || k)::double"},
    "series": {5: "'UNC'"},
    "class": {5: "'2B'", 6: "'6H'"},
    "depth_type": {7: "'thru'", 8: "'blind'"},
    "depth": {8: _PART},
    "label": {12: "'SIZE'"},
    "spec": {9: "text", 13: "text", 14: "text", 15: "text"},
}


def _case(values: dict[int, str]) -> str:
    return "case s " + " ".join(f"when {k} then {v}" for k, v in values.items()) + " end"


_TEXT = _case({k: "'" + t.replace("{n}", "' || n || '").replace("{d}", "' || d || '").replace("{k}", "' || k || '") + "'" for k, t in enumerate(SHAPES)})
_CATEGORY, _TYPE = (_case({k: f"'{c}'" for k, c in enumerate(names)}) for names in (_CATEGORIES, _TYPES))
_ITEMS = f"""n as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus)::int as seq,
      (l_suppkey % 2 + 1)::int as page, ((l_partkey + l_suppkey) % {len(SHAPES)})::int as s, l_quantity::int as n, (l_partkey % 90 + 10)::int as d, l_linenumber::int as k, (l_partkey % 3 * 10)::double as x,
      case when l_suppkey % 2 = 0 then 'pdf_text' else 'ocr' end as source, case when l_suppkey % 2 = 1 then l_linenumber / 10 end as confidence from lineitem),
    i as (select *, {_TEXT} as text, {_CATEGORY} as category, {_TYPE} as type from n)"""
#: Plain dimensions of a page in order; each that is free takes the first later free one that is beside it and one or two lines away.
_PAIRS = """c as (select doc_id, page, list({'seq': seq, 'x': x, 'v': ('0.' || d)::double, 't': text, 'c': confidence, 'o': source} order by seq) as items from i where s = 0 group by 1, 2 having count(*) > 1),
    r as (select doc_id, page, items, 1 as pos, []::bigint[] as used, []::bigint[] as pairs from c
      union all select doc_id, page, items, pos + 1, case when b is null then used else used || [pos, b] end, case when b is null then pairs else pairs || [pos, b] end
        from (select *, case when not list_contains(used, pos) then list_filter(range(pos + 1, len(items) + 1), lambda j: not list_contains(used, j) and abs(items[j].x - items[pos].x) <= 15 and (items[j].seq - items[pos].seq) * 12 between 5 and 30)[1] end as b from r where pos <= len(items))),
    p as (select doc_id, page, items[pairs[2 * j + 1]] as a, items[pairs[2 * j + 2]] as b from (select *, unnest(range(0, len(pairs) // 2)) as j from r where pos = len(items) + 1))"""
#: Threads of a page in order; each takes the nearest free depth whose middle is within four diagonals of a 30 by 10 box.
_GIVEN = """g as (select doc_id, page, list({'seq': seq, 'x': x} order by seq) filter (s in (5, 6)) as threads, list({'seq': seq, 'x': x, 'k': case s when 7 then 'thru' else 'blind' end, 'v': case s when 8 then ('0.' || d)::double end} order by seq) filter (s in (7, 8)) as depths from i group by 1, 2),
    w as (select doc_id, page, threads, depths, 1 as pos, []::bigint[] as used, []::bigint[] as pairs from g where len(threads) > 0 and len(depths) > 0
      union all select doc_id, page, threads, depths, pos + 1, case when b is null then used else used || [b] end, case when b is null then pairs else pairs || [pos, b] end
        from (select *, list_sort(list_transform(list_filter(range(1, len(depths) + 1), lambda j: not list_contains(used, j) and pow(depths[j].x - threads[pos].x, 2) + pow((depths[j].seq - threads[pos].seq) * 12, 2) <= 16000),
          lambda j: {'d': pow(depths[j].x - threads[pos].x, 2) + pow((depths[j].seq - threads[pos].seq) * 12, 2), 'j': j}))[1].j as b from w where pos <= len(threads))),
    t as (select doc_id, page, threads[pairs[2 * j + 1]].seq as thread_seq, depths[pairs[2 * j + 2]] as e from (select *, unnest(range(0, len(pairs) // 2)) as j from w where pos = len(threads) + 1))"""
#: All entries after both passes.
_PARSED = f"""e as (select i.doc_id, i.seq, i.page, i.text, i.category, i.type, i.s, i.n, i.d, i.k, t.e as own from i left join t on t.doc_id = i.doc_id and t.thread_seq = i.seq
      where not exists (select 1 from t u where u.doc_id = i.doc_id and u.e.seq = i.seq))"""
_WITH = f"with recursive {_ITEMS}, {_PAIRS}, {_GIVEN}, {_PARSED}"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_bbox(classify_distinct(drawing_items(spark, sf_dir)))


@register("drawing_classify", f"with {_ITEMS} select doc_id, seq, text, category, type, " + ", ".join(f"{_case(_VALUES[f]) if f in _VALUES else 'null'}::{'varchar' if kind == 'string' else kind} as {f}" for f, kind in FIELDS.items()) + " from i")
def drawing_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_distinct(drawing_items(spark, sf_dir)).select("doc_id", "seq", "text", "category", "type", *FIELDS)


@register("drawing_categories_by_order", f"with {_ITEMS} select doc_id, category, count(*) as n from i group by 1, 2")
def categories_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_distinct(drawing_items(spark, sf_dir)).groupBy("doc_id", "category").agg(F.count("*").alias("n"))


@register(
    "drawing_category_counts",
    f"""{_WITH}, f as (select category, count(*) as n from (select category from e union all select 'possible_limit_dimensions' from p) group by 1)
    select c.category, coalesce(n, 0) as n from (values {", ".join(f"('{c}')" for c in CATEGORIES)}) c(category) left join f on f.category = c.category""",
)
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.section_counts(spatial.parse_drawing(drawing_items(spark, sf_dir)), CATEGORIES)


_LIMIT_PAIRS = (
    f"""with recursive {_ITEMS}, {_PAIRS} select doc_id, page, a.seq as first_seq, b.seq as second_seq, greatest(a.v, b.v) as upper_limit, least(a.v, b.v) as lower_limit, null::varchar as unit, a.t || ' ' || b.t as members,
      least(a.x, b.x) as box_x, a.seq * 12.0::double as box_y, 30 + abs(a.x - b.x) as box_width, (b.seq - a.seq) * 12.0::double + 10 as box_height, least(coalesce(a.c, 1), coalesce(b.c, 1)) as confidence, a.o as source, 'needs_confirmation' as status from p"""
)


@register("limit_pairs", _LIMIT_PAIRS)
def limit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_pairs(spatial.limit_pairs(_entries(spark, sf_dir)))


@register("limit_pairs_in_rounds", _LIMIT_PAIRS)
def limit_pairs_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs by the grid and the rounds that pages of any size take."""
    return _flat_pairs(crowded.limit_pairs(_entries(spark, sf_dir)))


def _flat_pairs(pairs: DataFrame) -> DataFrame:
    pairs = pairs.withColumn("members", F.array_join("members", " "))
    return pairs.select("*", *[F.col(f"bbox.{k}").alias(f"box_{k}") for k in ("x", "y", "width", "height")]).drop("bbox")


_THREAD_DEPTHS = f"with recursive {_ITEMS}, {_GIVEN} select doc_id, page, thread_seq, e.seq as depth_seq, e.k as depth_type, e.v as depth from t"


@register("thread_depths", _THREAD_DEPTHS)
def thread_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.thread_depths(_entries(spark, sf_dir))


@register("thread_depths_in_rounds", _THREAD_DEPTHS)
def thread_depths_in_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same depths by the grid and the rounds that pages of any size take."""
    return crowded.thread_depths(_entries(spark, sf_dir))


def _shown(value: str, places: int) -> str:
    return f"rtrim(rtrim(printf('%.{places}f', {value}), '0'), '.')"


def _tags(*pairs: tuple[str, str]) -> str:
    return "'[' || " + " || ',' || ".join(f"""'{{"label":"{label}","value":"' || {value} || '"}}'""" for label, value in pairs) + " || ']'"


_PM, _NONE = "'±' || " + _shown(_SMALL, 3), "'—'"
_OWN = (("Depth Type", "coalesce(own.k, '—')"), ("Depth", f"coalesce({_shown('own.v', 2)}, '—')"))
_PRIMARY = {
    0: _shown(_PART, 2), 1: _shown(_WHOLE, 2), 2: "'Ø' || " + _shown(_PART, 2), 3: _shown(_PART, 2), 4: "k || 'X'", 5: "n || '/' || k || '-20 UNC'", 6: "'M' || n || ' x 1.' || k", 9: "n || ' pcs'",
    10: "'CODE ' || n", 11: "'6061-T6'", 12: "n || ' x ' || k", 15: "text", 16: _NONE, 17: _shown("1 + k / 2", 1) + " || ' in'",
}
_SHOWN = {
    0: _tags(("Tolerance", _NONE), ("Type", "type")), 1: _tags(("Tolerance", _PM), ("Type", "type")), 2: _tags(("Tolerance", _PM), ("Type", "type")), 3: _tags(("Type", "type"), ("Condition", "'MAX'")),
    4: _tags(("Feature", "'diameter'"), ("Size", _shown(_PART, 2)), ("Angle", _NONE), ("Remainder", "'THRU'")), 5: _tags(("Quantity", _NONE), ("Series", "'UNC'"), ("Class", "'2B'"), *_OWN),
    6: _tags(("Quantity", _NONE), ("Series", _NONE), ("Class", "'6H'"), *_OWN), 9: _tags(("Type", "type")), 10: _tags(("Type", "type")), 11: _tags(("Type", "type")), 12: _tags(("Label", "'SIZE'"), ("Type", "type")),
    15: _tags(("Type", "type")), 16: _tags(("Tolerance", f"{_shown(_WHOLE, 2)} || ' / ' || {_shown(_WHOLE, 2)}"), ("Type", "type")), 17: _tags(("Tolerance", _NONE), ("Type", "type")),
}
_LIMITS = _tags(("Status", "'needs_confirmation'"), ("Members", "a.t || ' / ' || b.t"))


@register(
    "display_records",
    f"""{_WITH} select doc_id, seq, category, {_case(_PRIMARY)} as "primary", {_case(_SHOWN)} as tags from e
    union all select doc_id, a.seq, 'possible_limit_dimensions', {_shown("greatest(a.v, b.v)", 2)} || ' / ' || {_shown("least(a.v, b.v)", 2)}, {_LIMITS} from p""",
)
def display_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = display.records(spatial.parse_drawing(drawing_items(spark, sf_dir)))
    return entries.select("doc_id", "seq", "category", "primary", F.to_json("tags").alias("tags"))


@register("finish_specifications", f"with {_ITEMS} select doc_id, row_number() over (partition by doc_id order by category = 'specifications', seq) as place, category, {_case(_VALUES['value_str'])} as shown from i where category in ('finishes', 'specifications')")
def finish_specifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = spatial.merged_section(_entries(spark, sf_dir), "finishes", "specifications")
    return merged.select("doc_id", F.col("place").cast("long").alias("place"), "category", F.col("value_str").alias("shown"))


_ROUTE_TEXT = "'  ' || l_returnflag || repeat('x', l_quantity::int % 12)"


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("  "), F.col("l_returnflag"), F.repeat(F.lit("x"), F.pmod(F.col("l_quantity").cast("int"), F.lit(12))))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 2 + 1).alias("page"), text.alias("text"), F.col("l_partkey").alias("part"))


@register(
    "page_routing",
    f"""with i as (select l_orderkey as doc_id, l_suppkey % 2 + 1 as page, sum(length(trim({_ROUTE_TEXT}))) as chars from lineitem group by 1, 2)
    select doc_id, count(*) as pages, count(*) filter (chars >= 20) as pages_pdf, count(*) filter (chars < 20) as pages_ocr,
      case when count(*) filter (chars < 20) = 0 then 'embedded' when count(*) filter (chars >= 20) = 0 then 'ocr' else 'mixed' end as mode from i group by 1""",
)
def page_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.modes(A.page_routes(_embedded(spark, sf_dir)))


@register(
    "routed_items",
    f"""with i as (select l_orderkey as doc_id, l_suppkey % 2 + 1 as page, {_ROUTE_TEXT} as text, l_partkey as part from lineitem), r as (select doc_id, page from i group by 1, 2 having sum(length(trim(text))) >= 20)
    select doc_id, page, text, part, 'pdf_text' as source from i semi join r using (doc_id, page) union all select doc_id, page, 'ocr ' || part, part, 'ocr' from i anti join r using (doc_id, page)""",
)
def routed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = _embedded(spark, sf_dir)
    recognised = embedded.withColumns({"text": F.concat(F.lit("ocr "), F.col("part").cast("string")), "source": F.lit("ocr")})
    return A.routed(embedded.withColumn("source", F.lit("pdf_text")), recognised)


_BOX_SQL = "(l_partkey % 50)::double as x, (l_suppkey % 40)::double as y, l_quantity as w, (l_linenumber * 3)::double as h"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = (F.col("l_partkey") % 50).cast("double"), (F.col("l_suppkey") % 40).cast("double"), F.col("l_quantity"), (F.col("l_linenumber") * 3).cast("double")
    box = A.polygon_box(F.array(x, y, x + w, y, x + w, y + h, x, y + h))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("text"), box.alias("b"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")).alias("c"))


@register("ocr_bbox", f"with p as (select l_orderkey, {_BOX_SQL}, case when l_linenumber % 2 = 0 then l_discount end as c from lineitem) select l_orderkey, min(x) as x, min(y) as y, max(x + w) - min(x) as width, max(y + h) - min(y) as height, round(avg(coalesce(c, 0)), 6) as confidence, count(*) as regions from p group by 1")
def ocr_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merged_regions(_regions(spark, sf_dir), ["l_orderkey"], "b", "c").withColumn("confidence", F.round("confidence", 6)).select("l_orderkey", "x", "y", "width", "height", "confidence", "regions")


@register(
    "merged_region_text",
    f"""with p as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as t, {_BOX_SQL} from lineitem)
    select l_orderkey, trim(string_agg(t, ' ' order by l_linenumber, l_partkey, t)) as text, min(x) as x, min(y) as y, max(x + w) - min(x) as width, max(y + h) - min(y) as height, count(*) as regions from p group by 1""",
)
def merged_region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _regions(spark, sf_dir).withColumn("at", F.struct("l_linenumber", "l_partkey"))
    merged = A.merged_regions(rows, ["l_orderkey"], "b", "c", text=A.joined_text("at", "text", " "))
    return merged.select("l_orderkey", F.trim("text").alias("text"), "x", "y", "width", "height", "regions")


@register(
    "recognised_items",
    f"""with p as (select l_orderkey, l_linenumber, l_partkey, l_returnflag as text, {_BOX_SQL}, case when l_linenumber % 2 = 0 then l_discount end as c from lineitem)
    select l_orderkey, l_linenumber, l_partkey, text, x, y, w as width, h as height, 'paddleocr' as source, coalesce(c, 0) as confidence, 0 as orientation from p where trim(text) <> ''""",
)
def recognised_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = A.recognised_item(F.col("text"), F.col("b"), F.col("c"), F.lit(None).cast("int"))
    rows = _regions(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", item.alias("i")).filter(F.trim("i.text") != "")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "i.text", "i.x", "i.y", "i.width", "i.height", "i.source", "i.confidence", "i.orientation")


@register(
    "embedded_items",
    "select l_orderkey, l_linenumber, l_partkey, floor((l_discount * 7 + l_partkey % 100) * 100 + 0.5) / 100 as x, floor((l_tax * 3) * 100 + 0.5) / 100 as y, floor(l_quantity * 100 + 0.5) / 100 as width, floor((l_linenumber * 1.25::double) * 100 + 0.5) / 100 as height, 'pdf_text' as source from lineitem",
)
def embedded_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = A.embedded_item(F.col("l_discount") * 7 + F.col("l_partkey") % 100, F.col("l_tax") * 3, F.col("l_quantity"), F.col("l_linenumber") * -1.25)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", box.alias("b")).select("l_orderkey", "l_linenumber", "l_partkey", "b.*", F.lit("pdf_text").alias("source"))


@register("cad_extension", "select p_partkey, case p_partkey % 5 when 0 then 'step' when 1 then 'iges' when 2 then 'brep' when 3 then 'step' end as kind from part")
def cad_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".STEP", ".igs", ".Brep", ".stp", ".pdf"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", extension(F.concat(F.lit("files/a.b/"), F.col("p_name"), ext)).alias("kind"))


@register(
    "mesh_view",
    """with m as (select o_orderkey as model, min(l_partkey % 97) as x0, max(l_partkey % 97) as x1, min(l_suppkey % 89) as y0, max(l_suppkey % 89) as y1, min(l_quantity) as z0, max(l_quantity) as z1, count(distinct l_linenumber) as meshes from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select model, meshes, (x0 + x1) / 2 as center_x, (y0 + y1) / 2 as center_y, (z0 + z1) / 2 as center_z, case when greatest(x1 - x0, y1 - y0, z1 - z0) = 0 then 10 else greatest(x1 - x0, y1 - y0, z1 - z0) end::double as max_dim,
      round(abs(case when greatest(x1 - x0, y1 - y0, z1 - z0) = 0 then 10 else greatest(x1 - x0, y1 - y0, z1 - z0) end / sin(pi() / 8)) * 0.7, 6) as distance from m""",
)
def mesh_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey")
    points = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("model"), F.col("l_linenumber").alias("mesh"), *[c.cast("double").alias(k) for k, c in (("x", F.col("l_partkey") % 97), ("y", F.col("l_suppkey") % 89), ("z", F.col("l_quantity")))])
    return A.mesh_view(points, "model", "mesh", fov=45.0).withColumn("distance", F.round("distance", 6))
