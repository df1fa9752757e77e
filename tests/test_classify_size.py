"""Classified texts are stored: no filter on them classifies rows, and pages are found where their documents lie."""

from pyspark.sql import functions as F

from quillspark.operators import crowded
from quillspark.operators.drawing import classify_distinct
from quillspark.plans import catalog


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_do_not_classify_rows(spark):
    items = spark.createDataFrame([(1, "FINISH: X"), (2, "Ø.5"), (3, None)], "k int, text string")
    got = classify_distinct(items).filter(F.col("category") == "finishes")
    assert [r["k"] for r in got.collect()] == [1] and "RLIKE" not in plan(got).upper()


def test_one_shuffle_of_items(spark):
    for name in ("thread_depths", "limit_pairs", "drawing_category_counts", "display_records", "finish_specifications"):
        assert plan(catalog.queries()[name](spark, "/root/testdata/sf0.001")).count("hashpartitioning(doc_id") == 1, name


def test_pages_of_one_block_need_no_rounds(spark, monkeypatch):
    paths, stored = [], crowded.stored
    monkeypatch.setattr(crowded, "stored", lambda df, path: (paths.append(path), stored(df, path))[1])
    edges = [(f"p{p}", k, 0.0, k + 1, 2 * k, 2 * k + 3) for p in range(5) for k in range(0, 40, 2)]
    df = spark.createDataFrame(edges, "page_key string, k1 long, k2 double, k3 long, u long, v long")
    assert crowded.matching(df, 64).count() == len(edges) and not any("settled" in p for p in paths)
    assert crowded.matching(df, 8).count() == len(edges) and any("settled" in p for p in paths)
