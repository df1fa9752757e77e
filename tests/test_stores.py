import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import filters
from quillspark.operators import providers
from quillspark.plans import stores
from quillspark.streaming import notices as N

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("regex", "want"), [("^abc", ("abc", True)), ("^a\\.b-", ("a.b-", True)), ("abc", ("", False)), ("^ab*c", ("a", False)), ("^ab?", ("a", False)), ("^ab{0,1}", ("a", False)), ("^ab+c", ("ab", False)), ("^a|b", ("", False)), ("^a\\|b", ("a|b", True)), ("^a\\d", ("a", False)), ("^(ab)", ("", False)), ("^", ("", True)), ("^ab$", ("ab", False))])
def test_literal_prefix(regex, want):
    assert filters.literal_prefix(regex) == want


def test_conditions(spark):
    names = ["A.1-01", "A.1-02", "AX1-01", None, "B"]
    df = spark.createDataFrame([(n, k % 2) for k, n in enumerate(names)], "name string, k int")
    found = lambda d: [r["name"] for r in df.filter(filters.condition(d)).collect()]
    assert found(None) == found("{}") == names
    assert found('{"k": 1}') == ["A.1-02", None] and found({"name": None}) == [None] and found({"name": "B", "k": 0}) == ["B"]
    assert found(filters.starting_with("name", "A.1-")) == ["A.1-01", "A.1-02"]
    assert found({"name": {"$regex": "^A.1-01$"}}) == ["A.1-01", "AX1-01"] and found({"name": {"$regex": "1-02"}}) == ["A.1-02"] and found({"name": {"$regex": "^"}}) == [n for n in names if n]
    for bad in ('{"k": {"$gt": 1}}', "[]", {"k": {"$regex": 1}}):
        with pytest.raises(ValueError):
            filters.condition(bad)


def test_prefixes_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/customer.parquet").filter(filters.condition(filters.starting_with("c_name", "Customer#0000001")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(c_name,Customer#0000001)" in plan and "RLIKE" not in plan


def actions(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(6), k * 90_000_000, k, rng.choice(["ADD", "ADD", "ADD", "UPDATE", "DISMISS", "REMOVE", "?"]), None if rng.random() < 0.03 else str(rng.randrange(9)), rng.choice([None, "x", "y"])) for k in range(n)]


SCHEMA = "user_id long, at long, seq long, kind string, id string, title string"


def test_stream_equals_batch(spark, tmp_path):
    given = actions(1, 600)
    for k in range(3):
        spark.createDataFrame(given[200 * k : 200 * k + 200], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last: dict = {}

    def keep(df, _):
        users: dict = {}
        for r in df.collect():
            users.setdefault(r["user_id"], []).append(tuple(r))
        last.update(users)

    N.notice_stream(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    batch = sorted(map(tuple, N.notices(spark.createDataFrame(given, SCHEMA).repartition(5)).collect()), key=str)
    assert sorted((r for rows in last.values() for r in rows if r[1] >= 0), key=str) == batch and batch


def test_limit_and_times(spark):
    given = [(1, k, k, "ADD", str(k), None) for k in range(30)] + [(1, 100, 100, "DISMISS", "29", None), (1, 200, 200, "UPDATE", "28", "new"), (1, 100 + 10**9 - 1, 300, "?", None, None), (None, 1, 1, "ADD", "1", None)]
    rows = N.notices(spark.createDataFrame(given, SCHEMA)).orderBy("place").collect()
    assert len(rows) == N.LIMIT and (rows[0]["id"], rows[0]["open"], rows[1]["title"]) == ("29", False, "new")
    rows = N.notices(spark.createDataFrame([*given, (1, 100 + 10**9, 301, "?", None, None)], SCHEMA)).orderBy("place").collect()
    assert len(rows) == N.LIMIT - 1 and rows[0]["id"] == "28"
    assert N.notices(spark.createDataFrame([], SCHEMA)).count() == 0


def test_actions_of_events(spark):
    rows = stores._actions(spark.read.parquet(f"{SF}/events.parquet")).groupBy("kind").agg(F.count("*")).collect()
    assert {r[0] for r in rows} == {"ADD", "UPDATE", "DISMISS", "REMOVE"}


def test_providers(spark):
    registry = providers.Registry("words")
    with pytest.raises(ValueError):
        registry.recognised(spark.createDataFrame([], "p long, n string, c string"), "p", "n", "c")
    registry.register("words", str.split)
    registry.register("sum", lambda c: [sum(map(int, c.split()))])
    with pytest.raises(ValueError):
        registry.register("sum", str.split)
    pages = spark.createDataFrame([(1, "sum", "1 2"), (2, "sum", "x"), (3, "?", "a b"), (4, None, "c"), (5, "sum", None), (6, "words", " ")], "p long, n string, c string")
    got = sorted(tuple(r) for r in registry.recognised(pages, "p", "n", "c").collect())
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(1, "sum", 0, "3"), (2, "sum", -1, None), (3, "words", 0, "a"), (3, "words", 1, "b"), (4, "words", 0, "c")]
    assert "ValueError" in got[1][4]
