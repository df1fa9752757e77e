import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import hard_negatives as h
from quillspark.llm import queries

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=100):
    """Every pair, in whole numbers."""
    kept = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * float(x))) for x in e]) for i, lab, e in rows if i is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for m, (i, lab, v) in enumerate(kept):
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, lab == other) for n, (j, other, w) in enumerate(kept) if n != m and len(w) == len(v)]
        scored.sort()
        for ps, pid, _ in [s for s in scored if s[2]][:5]:
            fits = [s for s in scored if not s[2] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:10]
            out += [(i, pid, k, nid, -ps, -ns) for k, (ns, nid, _) in enumerate(fits, 1)]
    return Counter(out)


def mined(spark, rows, every=100, schema=SCHEMA):
    found = h.hard_negatives(h.quantized(spark.createDataFrame(rows, schema).repartition(3)), every)
    return Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(0, 4)), (rng.normal(size=dim) * np.exp(rng.normal() * spread)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0, 1.0])
def test_equals_brute_force(spark, spread, monkeypatch):
    monkeypatch.setattr(h, "LEAST_ROWS", 16)
    monkeypatch.setattr(h, "SLICE", 8)
    monkeypatch.setattr(h, "ANCHORS", 7)
    rows = vectors(1, 700, 6, spread)
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_ties_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(h, "LEAST_ROWS", 16)
    monkeypatch.setattr(h, "SLICE", 8)
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), [rng.choice([0.25, 0.5, 1.0]) for _ in range(2)]) for i in range(300)] + [(500 + i, 1, [0.5, 0.5]) for i in range(200)]
    assert mined(spark, rows, 50) == brute(rows, 50)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0]), (2, 2, [0.5, 0.5]), (3, None, [9.0, 9.0]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (8, 2, [None, 1.0]), (None, 2, [1.0, 1.0]), (9, 2, [0.3]), (100, 2, [0.4]), (200, 3, []), (201, 4, []), (202, 3, []),
            (300, 5, [-1.0, -1.0]), (301, 5, [1.0, 1.0]), (400, 2, [0.0, 0.0]), (1, 1, [1.0, 1.0]), (0, 1, [1.0, 2.0]), (2, 2, [0.5, 0.5])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == Counter()
    assert mined(spark, [(0, 1, [1.0])]) == Counter()


@pytest.mark.parametrize("scale", [1e4, 1e6])
def test_large_components_stay_exact(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.normal(size=4) * scale).tolist()) for i in range(80)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_scores_beyond_64_bits_count_as_the_largest(spark):
    rows = [(i, i % 3, [1e15 * (i + 1)]) for i in range(12)]
    assert mined(spark, rows, 10) == Counter()  # all scores are equal, so none is 90 % of another


def test_buckets_are_skipped(spark, monkeypatch):
    """Where norms differ, the bounds keep most anchors from most slices."""
    calls = []
    monkeypatch.setattr(h, "_products", lambda a, c, f=h._products: calls.append(a.shape[0] * len(c)) or f(a, c))
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8)) * np.exp(rng.normal(size=(4000, 1)) * 2)
    import pyarrow as pa

    order = np.argsort(-np.linalg.norm(x, axis=1))
    x = np.floor(x[order] * 256)
    norm2 = (x * x).sum(1)
    cand = pa.table({"bucket": [0] * 4000, "anchor": [False] * 4000, "row": np.arange(4000), "vec_id": np.arange(4000), "label": np.arange(4000) % 2, "norm2": norm2, "v": list(x)})
    ask = cand.slice(0, 100).set_column(1, "anchor", pa.array([True] * 100)).append_column("windows", pa.array([[{"w": 0, "low": h._NONE, "high": h._MOST, "last": h._NONE}]] * 100))
    cand = cand.append_column("windows", pa.nulls(4000, ask.schema.field("windows").type))
    list(h._search(8, np.float64, False, 10)(iter(pa.concat_tables([cand, ask]).combine_chunks().to_batches())))
    assert sum(calls) < 0.6 * 100 * 4000


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    got = queries.op13_hard_negatives(spark, SF)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == brute(rows)
