import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import quotes
from quillspark.sources import snapshots

SCHEMA = "user_id long, at long, id long, status string, total double, patched array<string>"


def patches(seed, n, keys):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        held = [f for f in ("status", "total") if rng.random() < 0.5]
        out.append((rng.choice([None, *range(keys)]), rng.randrange(20), i, rng.choice("abc") if "status" in held and rng.random() < 0.8 else None, float(i) if "total" in held else None, held))
    return out


def stored(spark, path, **more):
    return snapshots.Store(spark, str(path), "user_id", ("at", "id"), ("status", "total"), **({"buckets": 3} | more))


def rows(df):
    return sorted((tuple(r) for r in df.select("user_id", "status", "total", "patches").collect()), key=str)


def test_batches_equal_the_fold_of_all(spark, tmp_path):
    given = patches(1, 400, 25)
    store = stored(spark, tmp_path / "s")
    frames = [spark.createDataFrame(given[a : a + 100], SCHEMA) for a in range(0, 400, 100)]
    done = [store.apply(frames[k], k) for k in (0, 1)]
    assert [*done, store.apply(frames[1], 1), store.apply(frames[0], 0), store.apply(frames[2], 2)] == [True, True, False, False, True]
    again = stored(spark, tmp_path / "s", buckets=64)  # another reader keeps the store's buckets
    assert again.apply(frames[3], 7)
    whole = quotes.latest_state(spark.createDataFrame(given, SCHEMA).filter("user_id is not null"), "user_id", ("at", "id"), ("status", "total"))
    assert rows(store.state()) == rows(whole)
    assert sum(p.name.startswith("v") for p in (tmp_path / "s").iterdir()) == 1 + snapshots.KEPT_VERSIONS


def test_only_the_batch_is_shuffled(spark, tmp_path):
    store = stored(spark, tmp_path / "s", buckets=8)
    store.apply(spark.createDataFrame(patches(2, 200, 50), SCHEMA), 0)
    merged = store.merged(spark.createDataFrame(patches(3, 20, 50), SCHEMA))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    old = plan[plan.index("FileScan") :]
    assert "Bucketed: true" in old
    above = plan[: plan.index("FileScan")]
    # the join reads the snapshot's buckets as they lie; all shuffles are below its other side, the batch
    assert "SortMergeJoin" in above and "Exchange" not in above and "Exchange hashpartitioning" in old


def test_conflict_and_orphans(spark, tmp_path, monkeypatch):
    a, b = stored(spark, tmp_path / "s"), stored(spark, tmp_path / "s")
    one = spark.createDataFrame(patches(4, 50, 5), SCHEMA)
    a.apply(one, 0)
    merged, raced = snapshots.Store.merged, []

    def late(self, p):
        out = merged(self, p)
        if self is b and not raced:
            raced.append(a.apply(one, 1))
        return out

    monkeypatch.setattr(snapshots.Store, "merged", late)
    with pytest.raises(snapshots.Conflict):
        b.apply(one, 1)
    assert raced == [True] and b.commit()["batch"] == 1
    assert not b.apply(one, 1)
    assert rows(b.state()) == rows(a.state())
    assert sum(r["patches"] for r in a.state().collect()) == 2 * one.filter("user_id is not null").count()


def test_nothing_applied_and_empty_batch(spark, tmp_path):
    store = stored(spark, tmp_path / "s")
    with pytest.raises(Exception, match="nothing has been applied"):
        store.state()
    store.apply(spark.createDataFrame([], SCHEMA), 0)
    assert store.state().collect() == []
    store.apply(spark.createDataFrame([(1, 1, 1, None, 2.0, ["status"])], SCHEMA), 1)
    assert rows(store.state()) == [(1, None, None, 1)]


def test_as_a_stream_sink(spark, tmp_path):
    given = patches(5, 300, 10)
    for k in range(3):
        spark.createDataFrame(given[100 * k : 100 * k + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = stored(spark, tmp_path / "s")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has lost its checkpoint's last commit
        query = stream.writeStream.foreachBatch(lambda df, n: store.apply(df, n) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        for f in sorted((tmp_path / "c" / "commits").glob("*"))[-1:]:
            f.unlink()
        for f in (tmp_path / "c" / "commits").glob(".*.crc"):
            f.unlink()
    whole = quotes.latest_state(spark.createDataFrame(given, SCHEMA).filter(F.col("user_id").isNotNull()), "user_id", ("at", "id"), ("status", "total"))
    assert rows(store.state()) == rows(whole)
