"""Page breaks by blocks against the loop over a whole document."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import breaks

MARGIN, BOTTOM = 40.0, 200.0


def by_loops(heights, page=1, y=MARGIN):
    out = []
    for h in heights:
        if y + h > BOTTOM:
            page, y = page + 1, MARGIN
        out.append((page, y))
        y += h
    return out, (page, y)


def test_functions_compose():
    rng = random.Random(5)
    for _ in range(300):
        parts = [[float(rng.choice([0, 0, 8, 24, 44, 90, 160, 170, 500])) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 6))]
        found = [breaks.steps(np.array(p), MARGIN, BOTTOM) for p in parts]
        whole = found[0]
        for f in found[1:]:
            whole = breaks.composed(whole, f, MARGIN)
        assert len(whole[0]) <= 2 + sum(min(len(p), 1 + 160 // 8) for p in parts)
        for y in (40.0, 41.0, 100.0, 199.0, 200.0, 201.0, 700.0):
            assert breaks.applied(whole, 1, y) == by_loops(sum(parts, []), 1, y)[1]


def test_steps_follow_the_page_not_the_block():
    assert len(breaks.steps(np.full(100_000, 8.0), MARGIN, BOTTOM)[0]) <= 1 + 160 // 8 + 1
    many = breaks.steps(np.full(5, 8.0), MARGIN, BOTTOM)
    for _ in range(1000):
        many = breaks.composed(many, breaks.steps(np.full(5, 8.0), MARGIN, BOTTOM), MARGIN)
    assert len(many[0]) <= 1 + 160 // 8 + 1


@pytest.mark.parametrize(("block", "fan"), [(1, 2), (7, 3), (50, 1024), (10_000, 1024)])
def test_blocks_equal_the_fold(spark, block, fan):
    rng = random.Random(block)
    docs = {d: [rng.choice([0.0, 24.0, 44.0, 90.0, 170.0, 500.0, None, -3.0]) for _ in range(n)] for d, n in (("a", 1), ("b", 140), (None, 60), ("d", 23))}
    rows = [(d, i - 20, h, -1) for d, hs in docs.items() for i, h in enumerate(hs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, i long, height double, page int")
    got = breaks.placed(df, "doc", F.floor(F.col("i") / block), ["i"], "height", MARGIN, BOTTOM, fan).collect()
    want = {(d, i - 20, *at) for d, hs in docs.items() for i, at in enumerate(by_loops([max(h or 0.0, 0.0) for h in hs])[0])}
    assert len(got) == len(rows) and {(r["doc"], r["i"], r["page"], r["top"]) for r in got} == want


def test_edges(spark):
    df = spark.createDataFrame([], "doc string, i long, height double")
    assert breaks.placed(df, "doc", F.col("i"), ["i"], "height", MARGIN, BOTTOM).count() == 0
    same = spark.createDataFrame([(1, None, 100.0), (1, None, 24.0), (1, 5, 100.0), (1, None, 24.0)], "doc long, i long, height double")
    got = breaks.placed(same, "doc", F.col("i"), ["i"], "height", MARGIN, BOTTOM).collect()
    assert sorted((r["height"], r["page"], r["top"]) for r in got) == [(24.0, 1, 40.0), (24.0, 1, 64.0), (100.0, 1, 88.0), (100.0, 2, 40.0)]


def test_small_blocks_are_packed(spark, monkeypatch):
    seen = {}
    stored = breaks.stored

    def counted(df, path):
        out = stored(df, path)
        seen[path.rsplit("/", 1)[1]] = out.count()
        return out

    monkeypatch.setattr(breaks, "stored", counted)
    rng = random.Random(8)
    docs = {d: [rng.choice([0.0, 24.0, 44.0, 90.0, 170.0]) for _ in range(n)] for d, n in (("a", 5000), ("b", 1), (None, 1500), ("d", 700))}
    df = spark.createDataFrame([(d, i if i > 9 else None, i, h) for d, hs in docs.items() for i, h in enumerate(hs)], "doc string, b long, i long, height double")
    got = breaks.placed(df, "doc", F.col("b"), ["i"], "height", MARGIN, BOTTOM).collect()
    want = {(d, i, *at) for d, hs in docs.items() for i, at in enumerate(by_loops(hs)[0])}
    assert {(r["doc"], r["i"], r["page"], r["top"]) for r in got} == want and len(got) == len(want)
    assert seen["functions-0"] <= sum(len(hs) // 1024 + 2 for hs in docs.values())


@pytest.mark.parametrize(("size", "fan"), [(1, 2), (7, 3), (50, 1024)])
def test_packed_blocks_equal_the_fold(spark, size, fan):
    rng = random.Random(size)
    docs = {d: [rng.choice([0.0, 24.0, 44.0, 90.0, 170.0, 500.0]) for _ in range(n)] for d, n in (("a", 1), ("b", 140), (None, 60), ("d", 23))}
    df = spark.createDataFrame([(d, i, h) for d, hs in docs.items() for i, h in enumerate(hs)], "doc string, i long, height double")
    got = breaks.placed(df, "doc", F.floor(F.col("i") / 3), ["i"], "height", MARGIN, BOTTOM, fan, size).collect()
    assert {(r["doc"], r["i"], r["page"], r["top"]) for r in got} == {(d, i, *at) for d, hs in docs.items() for i, at in enumerate(by_loops(hs)[0])}
