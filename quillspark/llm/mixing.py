"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import forget, written

#: Weights of the sources in code point order, repeating. Fixed values of the mix.
WEIGHTS = (5, 2, 1)
#: No source and no document is taken more often than this.
MOST = 3
#: A document's inclusion odds fall with its size as 2 ** (-level * DAMPING), level being the floor of log2(size).
DAMPING = 0.25
#: Ranks are cut into BINS, and the bin that holds the threshold into BINS again, so that no task sorts a whole source.
BINS = 1024
#: Documents that fill, the largest that fits first, what the last rank taken leaves of a target.
FILLS = 3
WORD = r"[^\x20\x09-\x0D]+"


def with_keys(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Add _size (words), _level, _u (a uniform number of the doc_id) and _tie (orders repeated doc_ids)."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}"))
    u = (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return docs.withColumns({"_size": size, "_u": u, "_tie": F.md5(F.coalesce("text", F.lit("")))}).withColumn("_level", F.when(F.col("_size") > 0, F.length(F.bin("_size")) - 1).otherwise(0).cast("int"))


def _filled(df: DataFrame, by: list[str], order: list[str], total: Column, cap: Column, unit: Column) -> DataFrame:
    """Water filling: adds _x with min(cap, c * unit) in each group ``by``, c such that these add up to ``total``.

    ``order`` sorts by cap / unit. A row is capped while that ratio is below what would be left for it per unit.
    """
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    level = F.coalesce(F.try_divide(F.greatest(total - F.coalesce(F.sum(cap).over(before), F.lit(0.0)), F.lit(0.0)), F.sum(unit).over(rest)), F.lit(0.0))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    df = df.withColumns({"_cap": cap, "_unit": unit}).withColumns({"_at": F.row_number().over(w), "_left": level})
    df = df.withColumn("_c", F.min(F.when(F.col("_cap") >= F.col("_left") * F.col("_unit"), F.struct("_at", "_left"))).over(own))
    x = F.when(F.col("_c").isNull() | (F.col("_at") < F.col("_c._at")), F.col("_cap")).otherwise(F.least("_cap", F.col("_c._left") * F.col("_unit")))
    return df.withColumn("_x", x).drop("_cap", "_unit", "_at", "_left", "_c")


def targets(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_src, _n (null marks), source_size and target of each source; at most a row for each source."""
    per = keyed.groupBy(*_source(keyed)).agg(F.sum("_size").alias("source_size"))
    rank = Window.orderBy("_null", "_src")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight.cast("double")).withColumns({"_all": F.sum("source_size").over(Window.partitionBy(F.lit(0)))})
    per = per.withColumn("_ratio", F.col("source_size") / F.col("_w"))
    per = _filled(per, [], ["_ratio", "_null", "_src"], F.col("_all").cast("double"), MOST * F.col("source_size").cast("double"), F.col("_w"))
    return per.select("_null", "_src", "source_size", F.col("_x").alias("target"))


def _source(df: DataFrame) -> list[Column]:
    return [F.col("source").isNull().alias("_null"), F.coalesce("source", F.lit("")).alias("_src")]


def _threshold(ranked: DataFrame, bins: str, room: Column) -> DataFrame:
    """Of each source the bin in which the running size passes ``room``, and the size before it; sources that have room for all are left out."""
    w = Window.partitionBy("_null", "_src").orderBy(bins).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranked.groupBy("_null", "_src", bins).agg(F.sum("_size").alias("_s"), F.first("_room").alias("_room"))
    sums = sums.withColumn("_upto", F.sum("_s").over(w))
    return sums.filter((F.col("_upto") > room) & (F.col("_upto") - F.col("_s") <= room)).select("_null", "_src", F.col(bins).alias(f"{bins}_at"), (room - (F.col("_upto") - F.col("_s"))).alias("_room_in"))


def _rank(df: DataFrame) -> DataFrame:
    """Pareto rank: random odds over inclusion odds, kept as a share of 1 so that it can be cut into bins."""
    q = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_pi") / (1 - F.col("_pi")))
    df = df.withColumn("_q", F.when(F.col("_pi") > 0, q / (1 + q)))
    df = df.withColumn("_b", F.floor(F.col("_q") * BINS).cast("int"))
    return df.withColumn("_bb", F.floor((F.col("_q") * BINS - F.col("_b")) * BINS).cast("int"))


def plan(keyed: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """What to take: expected copies by (source, level), and of each source the last rank taken. Both are written, small tables."""
    src = [c.alias(n) for c, n in zip(_source(keyed), ("_null", "_src"), strict=True)]
    slim = written(keyed.select("doc_id", *src, "_size", "_level", "_u", "_tie"), "mix-keys")
    per = targets(slim.withColumn("source", F.when(~F.col("_null"), F.col("_src"))), weights)
    levels = slim.groupBy("_null", "_src", "_level").agg(F.sum("_size").alias("_sum")).join(per, ["_null", "_src"])
    p = F.pow(F.lit(2.0), -DAMPING * F.col("_level"))
    levels = _filled(levels, ["_null", "_src"], ["_level"], F.col("target"), MOST * F.col("_sum").cast("double"), p * F.col("_sum"))
    e = F.when(F.col("_sum") > 0, F.round(F.col("_x") / F.col("_sum"), 9)).otherwise(F.lit(0.0))
    levels = levels.withColumn("_e", e).withColumn("_whole", F.floor("_e").cast("long")).withColumn("_pi", F.col("_e") - F.col("_whole"))
    room = F.col("target") - F.sum(F.col("_whole") * F.col("_sum")).over(Window.partitionBy("_null", "_src"))
    levels = written(levels.withColumn("_room", F.greatest(room, F.lit(0.0))).select("_null", "_src", "_level", "source_size", "target", "_whole", "_pi", "_room"), "mix-levels")

    ranked = _rank(slim.join(levels, ["_null", "_src", "_level"])).filter(F.col("_q").isNotNull())
    first = _threshold(ranked, "_b", F.col("_room"))
    inner = ranked.join(first, ["_null", "_src"]).filter("_b = _b_at").drop("_room").withColumnRenamed("_room_in", "_room").drop("_b_at")
    second = _threshold(inner, "_bb", F.col("_room"))
    last = inner.join(second, ["_null", "_src"]).filter("_bb = _bb_at")
    w = Window.partitionBy("_null", "_src").orderBy("_q", "doc_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("_before", F.coalesce(F.sum("_size").over(w), F.lit(0)))
    fits = last.filter(F.col("_before") + F.col("_size") <= F.col("_room_in"))
    taken = fits.groupBy("_null", "_src").agg(F.max(F.struct("_q", "doc_id", "_tie")).alias("_last"), F.max(F.col("_before") + F.col("_size")).alias("_used"))
    bins = first.drop("_room_in").join(second, ["_null", "_src"], "left").join(taken, ["_null", "_src"], "left")
    bins = written(bins.withColumn("_gap", F.col("_room_in") - F.coalesce("_used", F.lit(0))).select("_null", "_src", "_b_at", "_bb_at", "_last", "_gap"), "mix-ranks")
    for k in range(FILLS):
        others = ranked.join(bins, ["_null", "_src"]).filter(~_inside() & ~_filled_up(k) & (F.col("_size") <= F.col("_gap")))
        fill = others.groupBy("_null", "_src").agg(F.max(_key("_size")).alias(f"_fill{k}"))
        bins = written(bins.join(fill, ["_null", "_src"], "left").withColumn("_gap", F.col("_gap") - F.coalesce(F.col(f"_fill{k}._size"), F.lit(0))), "mix-fill")
    forget(slim)
    return levels, bins.drop("_gap")


def _key(*first: str) -> Column:
    return F.struct(*first, "_q", "doc_id", "_tie")


def _filled_up(rounds: int) -> Column:
    """True for documents that filled a gap in one of the first rounds."""
    out = F.lit(False)
    for k in range(rounds):
        out = out | F.coalesce(_key("_size") == F.col(f"_fill{k}"), F.lit(False))
    return out


def _inside() -> Column:
    """True for ranks up to the last one taken of the source."""
    within = F.coalesce(F.struct("_q", "doc_id", "_tie") <= F.col("_last"), F.lit(False))
    within = F.col("_bb_at").isNull() | (F.col("_bb") < F.col("_bb_at")) | ((F.col("_bb") == F.col("_bb_at")) & within)
    return F.col("_b_at").isNull() | (F.col("_b") < F.col("_b_at")) | ((F.col("_b") == F.col("_b_at")) & within)


def apply(keyed: DataFrame, levels: DataFrame, ranks: DataFrame) -> DataFrame:
    """Add _copies, source_size and target to every row. The two tables have a row for each source (and level); they are broadcast only below Spark's size limit."""
    keyed = keyed.withColumns({"_null": F.col("source").isNull(), "_src": F.coalesce("source", F.lit(""))})
    df = _rank(keyed.join(levels, ["_null", "_src", "_level"], "left")).join(ranks, ["_null", "_src"], "left")
    extra = F.when(F.col("_q").isNotNull() & (_inside() | _filled_up(FILLS)), 1).otherwise(0)
    return df.withColumn("_copies", F.coalesce("_whole", F.lit(0)) + extra)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for every row of ``docs`` (doc_id, text, source).

    size counts words (null text: 0). Sources in code point order, null last, get ``weights``, repeating; together they
    share all words; a target stops at MOST times its source and the rest is shared anew. Within a source, expected
    copies fall with size and stop at MOST; their whole part is taken for certain, their fraction is the inclusion odds of a
    Pareto sample: the documents with the least (random odds / inclusion odds) are taken while the target holds them, and
    FILLS others, the largest that fits first, fill what is left. Rows that repeat a doc_id and text share one rank and so one fate. Other columns are ignored; empty input
    gives no rows. A very long text is only counted.
    """
    keyed = with_keys(docs.select("doc_id", "text", F.col("source").cast("string").alias("source")), seed)
    out = apply(keyed, *plan(keyed, weights))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = 0) -> DataFrame:
    """The mix itself: every row of ``docs``, with its columns, as often as it is taken."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # keeps columns of any name apart from those added here
    keyed = with_keys(docs.select(row, "doc_id", "text", F.col("source").cast("string").alias("source")), seed)
    out = apply(keyed, *plan(keyed, weights)).filter("_copies > 0")
    return out.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int")))).select("_row.*")
