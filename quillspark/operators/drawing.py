"""Classifies the text items of engineering drawings and extracts their fields.

Eleven matchers in order of priority, each a condition and the fields it fills. The category is decided first and the fields are read per
category after that, so that every row evaluates the extracts of one matcher only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import js
from quillspark.functions.js import ANY, BOUND, WS
from quillspark.operators.phrases import ANYWHERE, WORDS, found
from quillspark.sources.snapshots import stored, work_folder

S = f"{WS}*"
NUM = r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
UNIT = r'(mm|in|cm|")'
CONDITION = r"(MAX|MIN|TYPICAL|TYP)"
DIAMETER_SIGN = r"(?:[Ø⌀ø]|DIA(?:\.(?![0-9]))?)"
LETTER_O = rf"O(?={S}[0-9]|{S}\.)"

#: Words that mark finishes, materials and notes.
FINISHES = (
    "hard anodize", "hardcoat", "hard coat", "hard anodized", "chem film", "chemical film", "alodine", "iridite", "passivate", "passivation", "passivated",
    "black oxide", "zinc plating", "zinc plated", "zinc plate", "nickel plating", "nickel plated", "nickel plate", "plate", "plating", "plated",
    "tin plating", "tin plated", "silver plating", "gold plating", "chromate", "phosphate", "phosphating", "galvanize", "galvanized", "galvanising",
    "galvanizing", "powder coat", "powder coating", "powdercoat", "e-coat", "electrocoat", "electrophoretic", "electropolish", "electropolished",
    "tumble finish", "tumbled", "vibratory finish", "bead blast", "sand blast", "sandblast", "shot blast", "brushed", "polished", "mirror finish",
    "matte", "matt", "paint", "painted", "primer", "anodize", "anodized", "anodise", "anodised", "mil-dtl", "mil-c", "mil-a", "mil-prf", "astm b117",
    "astm a967", "ams", "iso 9001",
)
MATERIALS = (
    "stainless steel", "stainless", "carbon steel", "alloy steel", "tool steel", "spring steel", "mild steel", "steel", "aluminum", "aluminium", "alum",
    "brass", "bronze", "copper", "cast iron", "ductile iron", "iron", "titanium", "titanium alloy", "inconel", "monel", "hastelloy", "tungsten", "zinc",
    "magnesium", "nickel", "cobalt", "chromoly", "nylon", "delrin", "acetal", "pom", "peek", "ultem", "pei", "abs", "polycarbonate", "acrylic", "pmma",
    "ptfe", "teflon", "hdpe", "ldpe", "pvc", "polypropylene", "phenolic", "garolite", "g10", "fr4",
)
NOTES = (
    "break sharp edges", "break all sharp edges", "deburr all edges", "deburr", "remove all burrs", "no burrs", "do not scale drawing", "do not scale",
    "unless otherwise specified", "u.o.s", "uos", "all dimensions in millimeters", "all dimensions in mm", "all dimensions in inches",
    "all dimensions in inch", "dimensions in mm", "dimensions in inches", "dimensions are in", "inspect per", "inspection per",
    "third angle projection", "first angle projection", "interpret per asme", "interpret drawing per", "conforms to", "in accordance with",
    "general tolerance", "general tolerances", "all edges broken", "edges to be broken", "typical", "typ", "all fillets r", "make from",
    "fabricate from", "machined from", "heat treat", "heat treatment", "stress relieve", "do not mark", "do not stamp", "permanent ink",
    "critical dimension", "critical feature",
)
#: Lists of a keyword table: the first two by words, with a boundary on both sides, notes anywhere.
LISTS = ("finishes", "materials", "notes")
GRADE = r"(?:6061|6063|7075|5052|2024|3003)(?:[-_]?T[0-9]+)?|303|304|316L?|17-4(?:PH)?|410|420|1018|1045|12L14|4140|4340|8620|A36|O1|D2|A2|S7"

#: Fields of a parsed entry besides category and type.
FIELDS = {
    "nominal": "double", "value_num": "double", "value_str": "string", "unit": "string", "tolerance_type": "string", "plus_tolerance": "double",
    "minus_tolerance": "double", "upper": "double", "lower": "double", "condition": "string", "ocr_substitution": "string", "quantity": "double",
    "feature": "string", "size": "double", "angle": "double", "remainder": "string", "thread_system": "string", "thread_nominal": "string",
    "threads_per_inch": "double", "pitch": "double", "series": "string", "class": "string", "depth_type": "string", "depth": "double",
    "label": "string", "spec": "string",
}
CATEGORIES = ("dimensions", "radii", "diameters", "quantities", "threads", "depths", "materials", "finishes", "notes", "unclassified", "possible_limit_dimensions", "specifications")


def _keywords(words: tuple[str, ...]) -> str:
    """One alternation: which word is found does not matter, only that one is."""
    return f"(?i){BOUND}(?:{'|'.join(w.replace(' ', WS + '+') for w in words)}){BOUND}"


#: n, n ± t, n +p/-m or n +p -m with optional units and a condition. Groups: number, unit, t, p, m, second unit, condition.
CALLOUT = f"(?i)^{NUM}{S}{UNIT}?(?:{S}(?:±{S}{NUM}|\\+{S}{NUM}{S}/?{S}-{S}{NUM}){S}{UNIT}?)?{S}{CONDITION}?{S}\\z"
TOLERANCED = f"(?i)^{NUM}{S}{UNIT}?{S}(?:±{S}{NUM}|\\+{S}{NUM}{S}/?{S}-{S}{NUM}){S}{UNIT}?\\z"
LIMIT = f"(?i)^([0-9]+\\.[0-9]+){S}/{S}([0-9]+\\.[0-9]+){S}{UNIT}?\\z"
FRACTION = f"^(?:([0-9]+)-)?([0-9]+)/([0-9]+){S}\\z"
PLAIN = f"(?i)^(?:[0-9]*\\.[0-9]+{S}{UNIT}?|[0-9]+{S}{UNIT})\\z"
DIAMETER = f"(?i)^(?:{DIAMETER_SIGN}|{LETTER_O}){S}({ANY}+)\\z"
RADIUS = f"(?i)^S?R{S}({ANY}+)\\z"
THREAD_COUNT = f"^([0-9]+){S}[xX]{S}(?=(?:[Mm][0-9]|[0-9]+/[0-9]+|[0-9]+{S}-))"
INCH_THREAD = f"^([0-9]+/[0-9]+|[0-9]+){S}-{S}([0-9]+){S}(UNEF|UNF|UNR|UNS|UNC|UN)(?:{S}-{S}([0-9][AB]))?\\z"
METRIC_THREAD = f"^M([0-9]+(?:\\.[0-9]+)?){S}[xX]{S}([0-9]+(?:\\.[0-9]+)?)(?:{S}-{S}([0-9]{{1,2}}[A-Ha-h](?:[0-9]{{1,2}}[A-Ha-h])?))?\\z"
FEATURE = f"^([0-9]+){S}[xX](?![A-Za-z0-9_]){S}({ANY}*)\\z"
CHAMFER = f"^{NUM}{S}[xX]{S}{NUM}{S}°{S}({ANY}*)\\z"
#: Groups: diameter sign, letter O, radius, size, unit, remainder.
FEATURE_SIZE = f"(?i)^(?:({DIAMETER_SIGN})|({LETTER_O})|(S?R))?{S}{NUM}{S}{UNIT}?{S}({ANY}*)\\z"
QUANTITIES = (
    f"(?i)QTY\\.?{S}[:=]?{S}([0-9]+)",
    f"(?i)\\({S}([0-9]+){S}(?:pcs|ea|pc|x|places|plces){S}\\)",
    f"(?i){BOUND}([0-9]+){S}(?:pcs|ea|places|plces){BOUND}",
    f"(?i){BOUND}TOTAL{S}[:=]?{S}([0-9]+)",
    f"^{S}([0-9]+){S}[xX]{BOUND}",
)
ROUGH = f"R[aAzZ]{S}([0-9]+(?:\\.[0-9]+)?)"
FINISH = f"(?i){BOUND}(?:SURFACE{WS}+)?FINISH(?:ED)?{S}[:=]?{S}({ANY}+)"
MATERIAL = f"(?i){BOUND}MAT(?:ERIAL|'L|L)\\.?{S}[:=]?{S}({ANY}+)"
SIZE = f"(?i){BOUND}SIZE\\.?{S}[:=]{S}({ANY}+)"
_DEPTH_NUM = r"([0-9]*\.[0-9]+|[0-9]+(?:\.[0-9]+)?)"
THROUGH = f"(?i)^(?:THRU{WS}+ALL|THROUGH|THRU)\\z"
DEPTH = f"(?i)^(?:(?:DEPTH|DEEP|DP|↧|↓){S}{_DEPTH_NUM}|{_DEPTH_NUM}{S}(?:DEEP|DP|DEPTH))\\z"
NOTE = f"(?i){BOUND}NOTES?{BOUND}"
NOTE_LINE = f"^{S}[0-9]{{1,2}}[.)]{WS}+({ANY}+)"

#: Matchers in order of priority, first match wins, and their categories.
MATCHERS = (
    ("diameter", "diameters"), ("radius", "radii"), ("thread", "threads"), ("feature", "quantities"), ("quantity", "quantities"), ("finish", "finishes"),
    ("material", "materials"), ("specification", "specifications"), ("depth", "depths"), ("dimension", "dimensions"), ("note", "notes"),
)


def _value(text: Column, pattern: str) -> Column:
    """What follows a label; '' if nothing does."""
    return js.trim(F.regexp_replace(F.regexp_extract(text, pattern, 1), f"^(?:{WS}|[:=-])+", ""))


def _phrase(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*[F.when(lower.contains(p), p) for p in NOTES])


def _conditions(t: Column, n: Column, c: Column, listed: dict[str, Column]) -> dict[str, Column]:
    """Whether each matcher takes the text t; n has ± for +/- and white space collapsed, c has × as X and white space collapsed; ``listed`` says
    of which keyword lists the text has a phrase.
    """
    body = lambda p: js.trim(F.regexp_extract(n, p, 1)).rlike(CALLOUT)
    threads = F.regexp_replace(c, THREAD_COUNT, "")
    dimension = n.rlike(TOLERANCED)
    for p in (LIMIT, FRACTION, PLAIN):
        dimension = dimension | n.rlike(p)
    quantity = F.lit(False)
    for p in QUANTITIES:
        quantity = quantity | t.rlike(p)
    return {
        "diameter": body(DIAMETER),
        "radius": body(RADIUS),
        "thread": threads.rlike(INCH_THREAD) | threads.rlike(METRIC_THREAD),
        "feature": js.collapsed(t).rlike(FEATURE),
        "quantity": quantity,
        "finish": t.rlike(ROUGH) | (_value(t, FINISH) != "") | listed["finishes"],
        "material": (_value(t, MATERIAL) != "") | listed["materials"] | t.rlike(f"(?i)^(?:{GRADE}){S}\\z"),
        "specification": js.trim(F.regexp_extract(t, SIZE, 1)) != "",
        "depth": js.collapsed(t).rlike(THROUGH) | js.collapsed(t).rlike(DEPTH),
        "dimension": dimension,
        "note": t.rlike(NOTE) | F.regexp_extract(t, NOTE_LINE, 1).rlike("[a-zA-Z]{2,}") | listed["notes"],
    }


def _unit(*cs: Column) -> Column:
    found = F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    return F.when(found == '"', "in").otherwise(F.lower(found))


def _fields(t: Column, n: Column, c: Column, body: Column, rest: Column, phrase: Column) -> dict[str, dict[str, Column]]:
    """type and fields by matcher; body is the numeric part of a callout or dimension, rest what follows a feature's count, phrase that of a note."""
    text, number = lambda s, p, k: F.nullif(js.trim(F.regexp_extract(s, p, k)), F.lit("")), lambda s, p, k: js.number(F.regexp_extract(s, p, k))
    whole = js.trim(t)
    call = lambda k: number(body, CALLOUT, k)
    callout = {
        "unit": _unit(F.regexp_extract(body, CALLOUT, 2), F.regexp_extract(body, CALLOUT, 6)),
        "tolerance_type": F.when(call(3).isNotNull(), "bilateral").when(call(4).isNotNull(), "unilateral").otherwise("none"),
        "plus_tolerance": F.coalesce(call(3), call(4)),
        "minus_tolerance": F.coalesce(call(3), call(5)),
    }
    threads = F.regexp_replace(c, THREAD_COUNT, "")
    inch, limit, fraction = threads.rlike(INCH_THREAD), body.rlike(LIMIT), body.rlike(FRACTION)
    chamfer = rest.rlike(CHAMFER)
    size = lambda k: F.when(~chamfer, text(rest, FEATURE_SIZE, k))
    labelled = lambda p: F.when(_value(t, p) != "", _value(t, p)).otherwise(whole)
    through = js.collapsed(t).rlike(THROUGH)
    depth = F.coalesce(number(js.collapsed(t), DEPTH, 1), number(js.collapsed(t), DEPTH, 2))
    numbered = F.regexp_extract(t, NOTE_LINE, 1).rlike("[a-zA-Z]{2,}")
    parts = js.divided(number(body, FRACTION, 2), number(body, FRACTION, 3))
    return {
        "diameter": {"type": F.lit("diameter"), "nominal": call(1), "ocr_substitution": F.when(n.rlike("(?i)^O"), "O→Ø"), **callout},
        "radius": {"type": F.when(n.rlike("(?i)^S"), "spherical_radius").otherwise("radius"), "value_num": call(1), "unit": callout["unit"], "condition": F.upper(text(body, CALLOUT, 7))},
        "thread": {
            "type": F.lit("thread"),
            "thread_system": F.when(inch, "inch").otherwise("metric"),
            "thread_nominal": text(threads, INCH_THREAD, 1),
            "threads_per_inch": number(threads, INCH_THREAD, 2),
            "series": text(threads, INCH_THREAD, 3),
            "class": F.coalesce(text(threads, INCH_THREAD, 4), text(threads, METRIC_THREAD, 3)),
            "nominal": number(threads, METRIC_THREAD, 1),
            "pitch": number(threads, METRIC_THREAD, 2),
            "quantity": number(c, THREAD_COUNT, 1),
        },
        "feature": {
            "type": F.lit("feature_callout"),
            "quantity": number(js.collapsed(t), FEATURE, 1),
            "feature": F.when(chamfer, "chamfer").when(size(1).isNotNull() | size(2).isNotNull(), "diameter").when(size(3).isNotNull(), F.when(F.length(size(3)) == 2, "spherical_radius").otherwise("radius")),
            "ocr_substitution": F.when(size(2).isNotNull(), "O→Ø"),
            "size": F.coalesce(number(rest, CHAMFER, 1), js.number(size(4))),
            "angle": number(rest, CHAMFER, 2),
            "unit": _unit(size(5)),
            "remainder": F.when(chamfer, text(rest, CHAMFER, 3)).when(size(4).isNotNull(), size(6)).otherwise(F.nullif(rest, F.lit(""))),
        },
        "quantity": {"type": F.lit("quantity"), "value_num": F.coalesce(*[number(t, p, 1) for p in QUANTITIES]), "unit": F.lit("pcs"), "spec": whole},
        "finish": {
            "type": F.when(t.rlike(ROUGH), "surface_roughness").otherwise("finish"),
            "value_str": F.when(t.rlike(ROUGH), F.concat(F.when(t.rlike("(?i)rz"), "Rz").otherwise("Ra"), F.lit(" "), F.regexp_extract(t, ROUGH, 1))).otherwise(labelled(FINISH)),
        },
        "material": {"type": F.lit("material"), "value_str": labelled(MATERIAL)},
        "specification": {"type": F.lit("specification"), "label": F.lit("SIZE"), "value_str": text(t, SIZE, 1)},
        "depth": {"type": F.lit("depth"), "depth_type": F.when(through, "thru").otherwise("blind"), "depth": F.when(~through, depth)},
        "dimension": {
            "type": F.when(limit, "limit_dimension").when(fraction, "fraction_dimension").otherwise("linear_dimension"),
            "nominal": F.when(fraction, F.coalesce(number(body, FRACTION, 1), F.lit(0.0)) + parts).when(~limit, call(1)),
            "unit": F.when(fraction, "in").when(limit, _unit(F.regexp_extract(body, LIMIT, 3))).otherwise(callout["unit"]),
            "tolerance_type": F.when(limit, "limit").otherwise(callout["tolerance_type"]),
            "plus_tolerance": callout["plus_tolerance"],
            "minus_tolerance": callout["minus_tolerance"],
            "upper": number(body, LIMIT, 1),
            "lower": number(body, LIMIT, 2),
        },
        "note": {"type": F.when(t.rlike(NOTE), "note_prefix").when(numbered, "numbered_note").otherwise("note_phrase"), "spec": F.when(t.rlike(NOTE) | numbered, whole).otherwise(phrase)},
    }


def classify(items: DataFrame, text: str = "text", phrases: dict[str, Column] | None = None) -> DataFrame:
    """Add category, type and FIELDS to every row of ``items``; a null text counts as empty, and a blank one is unclassified.

    Columns of ``items`` with those names are replaced. Steps that later ones use again stay projections of their own. ``phrases`` gives by list of
    LISTS the phrase that a text has, null for none, in place of the fixed keywords; see :func:`classify_listed`.
    """
    names = [m for m, _ in MATCHERS]
    lists = () if phrases is None else LISTS

    def matcher(x: Column) -> Column:
        chosen = F.when(~js.not_blank(x["t"]), -1)
        listed = {k: x[k].isNotNull() for k in lists} or {"finishes": x["t"].rlike(_keywords(FINISHES)), "materials": x["t"].rlike(_keywords(MATERIALS)), "notes": _phrase(x["t"]).isNotNull()}
        for k, fits in enumerate(_conditions(x["t"], x["n"], x["c"], listed).values()):
            chosen = chosen.when(fits, k)
        return F.struct(*[x[k].alias(k) for k in ("t", "n", "c", *lists)], chosen.otherwise(-1).alias("m"))

    def parts(x: Column) -> Column:
        of = lambda name: x["m"] == names.index(name)
        body = F.when(of("diameter"), js.trim(F.regexp_extract(x["n"], DIAMETER, 1))).when(of("radius"), js.trim(F.regexp_extract(x["n"], RADIUS, 1))).when(of("dimension"), x["n"])
        rest = F.when(of("feature"), js.trim(F.regexp_extract(js.collapsed(x["t"]), FEATURE, 2)))
        return F.struct(*[x[k].alias(k) for k in ("t", "n", "c", "m", *lists)], body.alias("body"), rest.alias("rest"))

    def parsed(x: Column) -> Column:
        fields = _fields(x["t"], x["n"], x["c"], x["body"], x["rest"], x["notes"] if lists else _phrase(x["t"])) | {"none": {"type": F.lit("unclassified"), "spec": js.trim(x["t"])}}
        columns = []
        for field, kind in {"type": "string", **FIELDS}.items():
            value = None
            for name, own in fields.items():
                if field in own:
                    value = (F if value is None else value).when(x["m"] == (-1 if name == "none" else names.index(name)), own[field])
            columns.append(value.cast(kind).alias(field))
        return F.struct(*columns)

    # Each step is a lambda over an array of one row: Spark evaluates those as they are, where one generated method for all patterns
    # would be too large for the JVM to compile.
    t = F.coalesce(F.col(text), F.lit(""))
    named = F.struct(t.alias("t"), js.collapsed(F.regexp_replace(t, f"\\+{S}/{S}-", "±")).alias("n"), F.replace(js.collapsed(t), F.lit("×"), F.lit("X")).alias("c"), *[phrases[k].alias(k) for k in lists])
    df = items.withColumn("_m", F.transform(F.array(named), matcher))
    m = F.col("_m")[0]["m"]
    category = F.element_at(F.array(*[F.lit(x) for _, x in MATCHERS], F.lit("unclassified")), F.when(m < 0, len(MATCHERS) + 1).otherwise(m + 1))
    df = df.withColumns({"category": category, "_f": F.transform(F.transform("_m", parts), parsed)[0]})
    return df.withColumns({k: F.col(f"_f.{k}") for k in ("type", *FIELDS)}).drop("_m", "_f")


def classify_distinct(items: DataFrame, text: str = "text") -> DataFrame:
    """:func:`classify` of each distinct text once, joined to its rows: drawings repeat most of what they say.

    Rows are the left side of a left join, so adaptive execution may split those of a frequent text among tasks. The classified texts are stored when
    this is called: a filter on them never classifies rows, and while they are few they are sent to the rows, which then stay where they are.
    """
    known = classify(items.select(F.col(text).alias("_text")).distinct(), "_text").select("_text", "category", "type", *FIELDS)
    known = stored(known, f"{work_folder(items.sparkSession)}/texts")
    own = items.drop("category", "type", *FIELDS)
    return own.join(known, own[text].eqNullSafe(known["_text"]), "left").drop("_text")


def dictionary(spark: SparkSession) -> DataFrame:
    """list, rule, phrase, place: the fixed keywords as a table, to be extended or replaced."""
    rows = [(name, rule, p, k) for name, rule, words in (("finishes", WORDS, FINISHES), ("materials", WORDS, MATERIALS), ("notes", ANYWHERE, NOTES)) for k, p in enumerate(words)]
    return spark.createDataFrame(rows, "list string, rule string, phrase string, place int")


def classify_listed(items: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """:func:`classify_distinct` with the keywords of a table (list of LISTS, rule, phrase, place) of any size in place of the fixed ones."""
    texts = items.select(F.col(text).alias("_text")).distinct()
    met = found(texts, keywords.filter(F.col("list").isin(*LISTS)), ["_text"], "_text")
    own = met.groupBy("_text").agg(*[F.max(F.when(F.col("list") == k, F.col("phrase"))).alias(f"_{k}") for k in LISTS])
    known = classify(texts.join(own, "_text", "left"), "_text", {k: F.col(f"_{k}") for k in LISTS}).select("_text", "category", "type", *FIELDS)
    rows = items.drop("category", "type", *FIELDS)
    return rows.join(known, rows[text].eqNullSafe(known["_text"]), "left").drop("_text")


def with_bbox(items: DataFrame) -> DataFrame:
    """Add bbox (x, y, width, height), null unless x and one of width and y are finite."""
    d = {k: F.col(k).cast("double") for k in ("x", "y", "width", "height")}
    ok = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))
    box = F.struct(d["x"].alias("x"), d["y"].alias("y"), *[F.coalesce(d[k], F.lit(0.0)).alias(k) for k in ("width", "height")])
    return items.withColumn("bbox", F.when(ok(d["x"]) & (ok(d["width"]) | ok(d["y"])), box))


def decimal_places(text: Column) -> Column:
    return F.length(F.regexp_extract(text, r"\.([0-9]+)", 1))
