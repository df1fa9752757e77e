"""Connected components of an edge table by alternating large-star and small-star rounds, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import forget, written


def _stars(edges: DataFrame, keep: str, mins: DataFrame) -> DataFrame:
    return edges.join(mins, "u").filter(keep)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a, b); self loops and repeats don't matter.

    A node's smallest neighbour comes from an aggregation and is joined back, so a hot node's edges are never gathered in one task
    or row. Each round is written, so lost executors cost one round at most. Rounds grow with the logarithm of the longest path; more than ``most_rounds``
    would take a path of over 2^50 nodes, so it only guards against an endless loop.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(mins, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        after = written(small, "edges")
        forget(now)
        now = after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("components did not settle")
    out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct(), "components")
    forget(now)
    return out
