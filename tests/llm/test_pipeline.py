"""Each stage of the pipeline on what the stage before kept, against brute force."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from quillspark.llm import decontaminate, quality
from quillspark.llm.common import written
from quillspark.llm.tokens import default_path, encode_whole, load
from tests.llm.test_joins import brute_components
from tests.llm.test_mixing import targets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = written(stage(spark, docs, SF), f"test-{name}")
        out.append((docs, after))
        docs = after
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_shape(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    for before, after in stages[:3]:
        assert 0 < after.count() <= before.count() and not set(ids(after)) - set(ids(before))


def test_quality_keeps_good(spark, stages):
    before, after = stages[0]
    scores = quality.score(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scores.filter("predicted = 1"))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(after))
    good = [d for d in ids(before) if labels.get(d) == 1]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_near_duplicates(stages):
    before, after = stages[1]
    found = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert ids(after) == sorted(d for d, (_, c) in found.items() if c == d)


def test_decontamination(spark, stages):
    before, after = stages[2]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in before.collect() if any(t in r["text"] for t in items)}
    assert not leaked & set(ids(after))
    other = set(ids(before)) - set(ids(after)) - leaked
    assert other <= {r["doc_id"] for r in decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}


def test_mixing(stages):
    before, after = stages[3]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    want, _ = targets(rows)
    largest: dict = {}
    for _, t, s in rows:
        largest[s] = max(largest.get(s, 0), len(t.split()))
    got: dict = {}
    for r in after.collect():
        got[r["source"]] = got.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for s, t in want.items():
        assert got.get(s, 0) <= t + 1 and got.get(s, 0) >= t - largest[s], s


def test_tokens(stages):
    before, after = stages[4]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    expected = sorted((d, len(x) + 1, zlib.crc32(np.array([*x, 2], "<u4").tobytes())) for (d, _), x in zip(rows, encode_whole(load(default_path()), [t for _, t in rows]), strict=True))
    got = after.orderBy("start").collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()


@pytest.fixture(scope="module")
def odd_run(spark, tmp_path_factory):
    """The whole pipeline over nulls, ties, repeated rows and columns whose names the operators use."""
    at = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("doc_id", "text", "lang", "source", "n_chars", "doc_id as _size", "text as ids", "source as target", "1.0 as score")
    first = docs.orderBy("doc_id").limit(1)
    long = first.selectExpr("9001L as doc_id", "repeat(concat(text, ' '), 400) as text", "lang", "source", "n_chars", "_size", "ids", "target", "score")
    nulls = first.selectExpr("explode(array(null, 9002L, 9003L)) as doc_id", "cast(null as string) as text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars", "_size", "ids", "target", "score")
    blank = first.selectExpr("9004L as doc_id", "'' as text", "lang", "source", "n_chars", "_size", "ids", "target", "score")
    rows = docs.unionByName(first).unionByName(long).unionByName(nulls).unionByName(blank)
    rows.write.parquet(f"{at}/documents.parquet")
    rows.limit(0).write.parquet(f"{at}/none/documents.parquet")
    for path in (at, at / "none"):
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
        spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id", "text", "text as doc_id").write.parquet(f"{path}/benchmark.parquet")
    return str(at)


def test_odd_rows_through_all_stages(spark, odd_run):
    docs = spark.read.parquet(f"{odd_run}/documents.parquet")
    start, counts = docs, []
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, odd_run), f"odd-{name}")
        counts.append(docs.count())
        assert name == "tokens" or docs.columns == start.columns
    got = docs.orderBy("start").collect()
    assert len(got) == counts[3] and [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    assert pipeline.run(spark, odd_run).count() == len(got)


def test_nothing_through_all_stages(spark, odd_run):
    assert pipeline.run(spark, f"{odd_run}/none").count() == 0
