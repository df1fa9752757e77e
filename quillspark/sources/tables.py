"""Readers: the driver's tables, JSON envelopes, and drawing text items computed from line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, most: int = 500_000) -> DataFrame:
    """Rows of a table by ``key`` in tasks of some ``most`` rows, so that what a task sorts or groups does not grow with the table."""
    fixed = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(fixed, rows.count() // most + 1), key)


def unwrapped(json: Column, item: str) -> Column:
    """Items of an envelope: a bare array, or one under items or data; none otherwise. ``item`` is the items' DDL type."""
    bare = F.from_json(json, f"array<{item}>")
    wrapped = F.from_json(json, f"struct<items:array<{item}>,data:array<{item}>>")
    return F.coalesce(F.when(json.startswith("["), bare), wrapped["items"], wrapped["data"], F.array().cast(f"array<{item}>"))


def extension(path: Column) -> Column:
    """Kind of CAD file by its extension: step, iges or brep; null for others."""
    ext = F.lower(F.substring_index(path, ".", -1))
    return F.when(ext.isin("step", "stp"), "step").when(ext.isin("iges", "igs"), "iges").when(ext == "brep", "brep")


#: Texts of the computed items; {n}, {d} and {k} stand for the quantity, two digits and the line. Fixed values.
SHAPES = (
    ".{d}", "{n}.{d}±.00{k}", "Ø.{d}±.00{k}", "R.{d} MAX", "{k}X Ø.{d} THRU", "{n}/{k}-20 UNC-2B", "M{n}x1.{k}-6H", "THRU", ".{d} DEEP", "QTY: {n}",
    "FINISH: CODE {n}", "6061-T6", "SIZE: {n} x {k}", "SEE NOTE {k}", "{n}. Deburr all edges", "PLAIN {n}", "{n}.{d}0/{n}.{d}", "1-{k}/2",
)


def drawing_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seq, page, text, x, y, width, height, source, confidence: a text item for each line item, by whole-number arithmetic on its columns.

    Line items that repeat number and order are told apart by all their columns.
    """
    from pyspark.sql import Window

    # named before the window, so that what groups by document later finds its rows together
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    seq = F.row_number().over(order)
    n, d, k = F.col("l_quantity").cast("int"), F.pmod("l_partkey", F.lit(90)) + 10, F.col("l_linenumber")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(len(SHAPES))) + 1).cast("int"))
    text = shape
    for mark, value in (("{n}", n), ("{d}", d), ("{k}", k)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return li.select(
        "doc_id", seq.alias("seq"), (F.pmod("l_suppkey", F.lit(2)) + 1).cast("int").alias("page"), text.alias("text"),
        (F.pmod("l_partkey", F.lit(3)) * 10).cast("double").alias("x"), (seq * 12).cast("double").alias("y"), F.lit(30.0).alias("width"), F.lit(10.0).alias("height"),
        F.when(F.pmod("l_suppkey", F.lit(2)) == 0, "pdf_text").otherwise("ocr").alias("source"), F.when(F.pmod("l_suppkey", F.lit(2)) == 1, F.col("l_linenumber") / 10).alias("confidence"),
    )


def checked_extension(path: Column) -> Column:
    """:func:`extension`, but an error for files of other kinds."""
    return F.coalesce(extension(path), F.raise_error(F.concat(F.lit("no CAD file: "), F.coalesce(path, F.lit("null")))).cast("string"))
