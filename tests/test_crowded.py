import random
import time

import pytest

from quillspark.operators import crowded, spatial
from tests.test_drawing import entries, pair_by_loops


def page(seed, docs, most, spread):
    rng = random.Random(seed)
    size = lambda: rng.choice([(0.0, 0.0), (30.0, 10.0), (30.0, 10.0), (70.0, 9.0), (12.0, 25.0)])
    return [(d, s, rng.choice([1, 2, None]), rng.choice([".480", ".478", "1.25", "2.5", "M6x1", "THRU", ".5 DEEP"]), float(rng.randint(0, spread) * 7), float(rng.randint(-spread, spread) * 5), *size(), "ocr", rng.choice([None, 0.9])) for d in range(docs) for s in range(rng.randint(1, most))]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(("seed", "docs", "most", "spread", "block"), [(1, 25, 30, 12, 4096), (2, 3, 160, 20, 7), (3, 1, 250, 3, 16)])
def test_rounds_equal_the_fold(spark, seed, docs, most, spread, block):
    e = entries(spark, page(seed, docs, most, spread)).cache()
    assert rows(crowded.limit_pairs(e, block)) == rows(spatial.limit_pairs(e))
    assert rows(crowded.thread_depths(e, block)) == rows(spatial.thread_depths(e))


def test_edges(spark):
    nan = float("nan")
    items = [(1, 1, 1, ".480", nan, 200.0, 30.0, 10.0, "ocr", None), (1, 2, 1, ".478", 100.0, 212.0, 30.0, 10.0, "ocr", None), (2, 1, 1, "M6x1", None, 1.0, 1.0, 1.0, "ocr", None), (2, 2, 1, "THRU", 1.0, 1.0, 1.0, 1.0, "ocr", None)]
    for given in (items, []):
        e = entries(spark, given) if given else entries(spark, items).limit(0)
        assert crowded.limit_pairs(e).collect() == crowded.thread_depths(e).collect() == []


def test_a_chain_over_many_blocks(spark):
    """Each entry fits the next only, so that every edge waits for the one before it."""
    items = [(1, s, 1, ".480", 5.0, s * 12.0, 30.0, 10.0, "ocr", None) for s in range(300)]
    got = crowded.limit_pairs(entries(spark, items), 64).collect()
    assert {(r["doc_id"], r["page"], r["first_seq"], r["second_seq"]) for r in got} == pair_by_loops(items)


def test_a_page_of_100_000_entries(spark):
    rng = random.Random(9)
    e = entries(spark, [(1, s, 1, rng.choice([".480", ".478", "M6x1", "THRU"]), rng.random() * 20_000, rng.random() * 20_000, 30.0, 10.0, "ocr", None) for s in range(100_000)]).repartition(8).cache()
    began = time.time()
    pairs, depths = crowded.limit_pairs(e).cache(), crowded.thread_depths(e).cache()
    assert pairs.count() > 1000 and depths.count() > 10_000
    ends = [r[c] for r in pairs.select("first_seq", "second_seq").collect() for c in (0, 1)]
    given = [r[0] for r in depths.select("depth_seq").collect()]
    assert len(ends) == len(set(ends)) and len(given) == len(set(given))
    assert time.time() - began < 400
