"""Display records of parsed drawing entries: a primary text and labelled tags, one mapper for each category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import js, text


def _tag(label: str, value: Column) -> Column:
    return F.struct(F.lit(label).alias("label"), value.cast("string").alias("value"))


def _tags(*pairs: tuple[str, Column, Column | None]) -> Column:
    """Tags in order; one with a condition is left out where that does not hold."""
    return F.filter(F.array(*[F.when(F.lit(True) if when is None else when, _tag(label, value)) for label, value, when in pairs]), lambda t: t.isNotNull())


def records(entries: DataFrame) -> DataFrame:
    """Add primary and tags (array of label, value) to parsed entries; depths and notes, which have no section, get null."""
    c = lambda k: F.col(k) if k in entries.columns else F.lit(None).cast("array<string>" if k == "members" else "string")
    e = F.struct("tolerance_type", "plus_tolerance", "minus_tolerance", "upper", "lower")
    dash = lambda k: js.or_text(c(k), F.lit("—"))
    num = lambda k: F.coalesce(js.number_text(c(k)), F.lit("—"))
    unit = F.when(F.coalesce(c("unit"), F.lit("")) != "", F.concat(F.lit(" "), c("unit"))).otherwise("")
    tol, kind = ("Tolerance", text.tolerance_text(e), None), ("Type", dash("type"), None)
    feature = (c("category") == "quantities") & (c("type") == "feature_callout")
    metric = F.concat(F.lit("M"), num("nominal"), F.when(c("pitch").isNotNull(), F.concat(F.lit(" x "), js.number_text(c("pitch")))).otherwise(""))
    inch = F.concat(c("thread_nominal"), F.lit("-"), js.number_text(c("threads_per_inch")), F.when(c("series").isNotNull(), F.concat(F.lit(" "), c("series"))).otherwise(""))
    thread = F.when(c("thread_system") == "metric", metric).otherwise(inch)
    rows = [
        (c("category") == "dimensions", F.concat(num("nominal"), unit), _tags(tol, kind)),
        (c("category") == "radii", F.concat(num("value_num"), unit), _tags(kind, ("Condition", dash("condition"), None))),
        (c("category") == "diameters", F.concat(F.lit("Ø"), num("nominal"), unit), _tags(tol, kind, ("OCR", c("ocr_substitution"), c("ocr_substitution").isNotNull()))),
        (feature, F.concat(num("quantity"), F.lit("X")), _tags(("Feature", dash("feature"), None), ("Size", F.when(c("size").isNotNull(), F.concat(num("size"), unit)).otherwise("—"), None), ("Angle", F.when(c("angle").isNotNull(), F.concat(num("angle"), F.lit("°"))).otherwise("—"), None), ("Remainder", c("remainder"), F.coalesce(c("remainder"), F.lit("")) != ""))),
        (c("category") == "quantities", F.concat(num("value_num"), F.lit(" "), js.or_text(c("unit"), F.lit("pcs"))), _tags(("Type", js.or_text(c("type"), F.lit("quantity")), None))),
        (c("category").isin("materials", "finishes"), dash("value_str"), _tags(kind)),
        (c("category") == "specifications", dash("value_str"), _tags(("Label", dash("label"), None), kind)),
        (c("category") == "threads", thread, _tags(("Quantity", num("quantity"), None), ("Series", dash("series"), None), ("Class", dash("class"), None), ("Depth Type", dash("depth_type"), None), ("Depth", num("depth"), None))),
        (c("category") == "possible_limit_dimensions", F.concat(num("upper"), F.lit(" / "), num("lower"), unit), _tags(("Status", dash("status"), None), ("Members", js.or_text(F.array_join(c("members"), " / "), F.lit("—")), None))),
        (c("category") == "unclassified", js.or_text(c("spec"), c("text"), F.lit("—")), _tags(kind)),
    ]
    primary, tags = None, None
    for cond, p, t in rows:
        primary, tags = (F if primary is None else primary).when(cond, p), (F if tags is None else tags).when(cond, t)
    return entries.withColumns({"primary": primary, "tags": tags})
