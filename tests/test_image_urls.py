"""Addresses at size: what is used again is computed once."""

from pyspark.sql import functions as F

from quillspark.functions import text, urls


def test_each_part_of_an_address_is_computed_once(spark):
    df = spark.createDataFrame([], "u string")
    for made, most in ((urls.resolve(F.col("u")), 40), (text.media_source(F.col("u"), {"a.example.com": "/"}), 45)):
        assert df.select(made.alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_") <= most
