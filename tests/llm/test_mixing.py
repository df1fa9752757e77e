"""Mixing against plain loops: targets, copies, closeness, repeats, odd rows; and against SQL."""

import random
import re

import duckdb
import pytest

from quillspark.llm import mixing, oracles

SCHEMA = "doc_id long, text string, source string, target int, _size int, size string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, s, 1, 2, "clash") for d, t, s in rows], SCHEMA)


def targets(rows):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, open_, rest = {}, set(size), float(sum(size.values()))
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s] + 1e-9]
        if not over:
            return out | share, size
        for s in over:
            out[s] = 3.0 * size[s]
            rest -= out[s]
            open_.discard(s)
    return out, size


@pytest.mark.parametrize("seed", [1, 2])
def test_mix(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "ä", "z", "Z", "tiny"]
    rows = [(i, "w " * int(rng.paretovariate(2.5) * 9), "tiny" if i < 3 else rng.choice(sources[:-1])) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", None), (5002, " \n\t", "b"), (None, "one two", "a"), (7, "w w w", "b"), (7, "w w w", "b")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    want, size = targets(rows)
    assert len(got) == len(rows)
    per = {}
    source_of = {(d, len((t or "").split())): s for d, t, s in rows}
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        per[s] = per.get(s, 0) + r["taken"]
    for s, n in per.items():
        assert abs(n - want[s]) <= max(3, 0.02 * want[s]), s
    again = mixing.mix(frame(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)


def test_copies_follow_size(spark):
    rows = [(i, "w " * (4 if i % 2 else 400), "s" if i < 1600 else "t") for i in range(2400)]
    got = mixing.mix(frame(spark, rows)).collect()
    mean = lambda size: sum(r["copies"] for r in got if r["size"] == size and r["source_size"] > 300_000) / 800
    assert mean(4) > 1.5 * mean(400)


def test_odd_tables(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    blank = mixing.mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r["taken"], r["target"]) for r in blank] == [(0, 0, 0.0)] * 2
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, "a b c", None)])).collect()] == [3]


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{path}'")
    found = c.execute(oracles.MIX)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    assert sorted(map(tuple, mixing.mix(spark.read.parquet(path)).select(*names).collect())) == want
