"""Tasks of a bounded number of rows."""

from quillspark.sources.tables import dealt


def test_tasks_grow_with_the_rows(spark):
    rows = spark.range(5_000).selectExpr("id % 700 as k", "id")
    fixed = int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = dealt(rows, "k", 100)
    assert got.rdd.getNumPartitions() == 51 and got.count() == 5_000
    assert max(got.rdd.glom().map(len).collect()) < 500
    assert dealt(rows, "k").rdd.getNumPartitions() == fixed
