"""Quality scores and language ID: held-out accuracy, and what null or odd rows give."""

import random

import numpy as np
import pytest

from quillspark.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_features_of_odd_texts():
    for t in (None, "", "   \n", "a", "é" * 100_000, "!" * 50, "\n\n\n", "😀"):
        x = quality.features(t)
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.score(docs, labels)
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    wins = sum(g > b for g in good for b in bad) / (len(good) * len(bad))
    assert wins > 0.95
    assert sum(s >= 0.3 for s in good) / len(good) > 0.95


def test_quality_uses_no_held_out_label(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(string(doc_id) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    key = lambda df: sorted((r["doc_id"], r["score"]) for r in df.collect())
    assert key(quality.score(docs, labels)) == key(quality.score(docs, turned))


def test_quality_without_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, "", 7), (None, "text", 7)], "doc_id long, text string, quality int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score(docs, none).collect()
    assert len(rows) == 3 and {r["score"] for r in rows} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, None), (1, 9), (None, 0)], "doc_id long, quality int")
    assert quality.score(docs, some).count() == 3
    assert quality.score(docs.limit(0), some).count() == 0
    assert quality.kept(docs, none).columns == docs.columns and quality.kept(docs, none).count() == 3


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("abc " if i % 2 else "xyz ") for _ in range(200)), "one" if i % 2 else "two") for i in range(80)]
    rows += [(100, None, "one"), (101, "", None), (102, "12 !? 3", "one"), (None, "abc cab", None), (3, rows[3][1], "one"), (103, "xyz " * 20_000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert [by[k]["lang_pred"] for k in (100, 101, 102, None, 103)] == ["und", "und", "und", "one", "two"]
    assert by[100]["score"] == 0.0 and not by[None]["held_out"]
    untaught = langid.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in untaught] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_windows_hold_all_bytes(n):
    raw = bytes(range(1, 256)) * 4
    w = langid.windows(raw[:n])
    assert w.tobytes().rstrip(b"\0") == raw[:n] and w.shape[1] == langid.WINDOW


def test_convolution_against_loops():
    rng = np.random.default_rng(2)
    some = [rng.integers(97, 105, 90, np.uint8).tobytes() for _ in range(40)]
    x = np.stack([langid.windows(s)[0] for s in some])
    model = langid.fit(x, np.arange(40) % 3, ["a", "b", "c"], epochs=1)
    text = (some[0] + some[1]).decode()
    total = np.zeros(3)
    for at in range(0, len(text), langid.WINDOW):
        raw = text.encode()[at : at + langid.WINDOW]
        row = raw.ljust(langid.WINDOW, b"\0")
        pooled = []
        for table in model.tables:
            for f in range(langid.FILTERS):
                pooled.append(max(sum(float(table[k][row[i + k]][f]) for k in range(len(table))) for i in range(langid.WINDOW - len(table) + 1)))
        z = [sum(max(0.0, p + float(b)) * float(model.dense[i, c]) for i, (p, b) in enumerate(zip(pooled, model.bias, strict=True))) + float(model.dense_bias[c]) for c in range(3)]
        odds = np.exp(np.array(z) - max(z))
        total += len(raw) * np.log(odds / odds.sum())
    p = np.exp(total / len(text))
    p /= p.sum()
    langs, scores = model.predict([text], model.pairs())
    assert langs == ["abc"[p.argmax()]] and abs(scores[0] - p.max()) < 1e-4


def test_numbers_are_no_letters(spark):
    rows = [(i, "abc ab cab " if i % 2 else "xyz zy zx ", "one" if i % 2 else "two", "l", 1.0) for i in range(40)] + [(50, "½ ² ① 12", None, "l", 1.0), (51, "ªb", None, "l", 1.0)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")).collect()}
    assert got[50] == "und" and got[51] in ("one", "two")


def test_every_language_is_learnt(spark):
    rows = [(1000 * k + i, f"{chr(0x4E00 + k)}{chr(0x4E00 + k)} " * 6, f"l{k:03}") for k in range(300) for i in range(4)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted({r[2] for r in rows}) and model.dense.shape[1] == 300


def test_ranking_against_loops():
    """The fitted weights are where the pairs' logistic loss, summed by loops, has no slope; the cut is the quantile of scores."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, len(quality.FEATURES)))
    y = (x[:, 0] + 0.8 * rng.normal(size=60) > 0.2).astype(np.int64)
    model = quality.fit(x, y, pairs=200, seed=5, ridge=0.05)
    draw, basis = np.random.default_rng(5), []
    for row in x:
        z = [min(4, max(-4, (v - m) / s)) for v, m, s in zip(row, x.mean(0), x.std(0), strict=True)]
        basis.append(z + [v * v for v in z] + [max(v - 1, 0) for v in z] + [max(-v - 1, 0) for v in z])
    good, bad = [i for i in range(60) if y[i]], [i for i in range(60) if not y[i]]
    slope = -0.05 * model.weights
    for a, b in zip(draw.choice(good, 200), draw.choice(bad, 200), strict=True):
        d = np.array(basis[a]) - np.array(basis[b])
        slope = slope + d / (1 + np.exp(d @ model.weights)) / 200
    assert np.abs(slope).max() < 1e-3
    scores = [sum(w * v for w, v in zip(model.weights, b, strict=True)) for b in basis]
    assert abs(model.cut - np.quantile(scores, 0.99 * len(bad) / 60)) < 1e-9
    want = [1 / (1 + np.exp(-(s - model.cut)) * 0.7 / 0.3) for s in scores]
    assert np.allclose(model.scores(x), want)
