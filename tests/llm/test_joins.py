"""N-gram join, decontamination and nearest neighbours against brute force; components against union-find."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import ann, decontaminate, ngram_join
from quillspark.llm.components import components

DOCS = "doc_id long, text string, n long, key long, row string"


def sets_of(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def brute_components(rows, k, percent):
    sets = {d: sets_of(t, k) for d, t in rows}
    parent = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(parent, a), find(parent, b)))
                parent[q] = p
    return {d: (len(sets[d]), find(parent, d)) for d in ids}


def copies(rng, n, groups, words, edits):
    vocab = [f"w{k}" for k in range(400)]
    out = []
    shared = [rng.choice(vocab) for _ in range(30)]
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, words))]
        if g % 3 == 0:
            base += shared
        for _ in range(n):
            text = list(base)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice(vocab)
            out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("k", "percent", "edits"), [(4, 85, 2), (5, 80, 3), (1, 85, 5)])
def test_components_equal_brute_force(spark, monkeypatch, k, percent, edits):
    monkeypatch.setattr(ngram_join, "SATURATED", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 8)
    rng = random.Random(k)
    some = [*copies(rng, 12, 14, 120, edits), *copies(rng, 40, 2, 60, 6), "", "  \n ", "one", "ONE", "one two", "a b c", "A  b\tc", "a b c"]
    ids = rng.sample(range(5000), len(some))
    rows = list(zip(ids, some, strict=True))
    df = spark.createDataFrame([(d, t, 1, 2, "clash") for d, t in rows], DOCS).repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(df, k, percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f", 1, 1, "x"), (None, None, 1, 1, "x"), (4, None, 1, 1, "x"), (5, "", 1, 1, "x"), (7, "a b c d e f", 1, 1, "x"), (7, "a b c d e f", 1, 1, "x"), (6, "A B C D E F", 1, 1, "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, ngram_join.ngram_components(df).collect()), key=str)
    assert got == sorted([(None, 3, None), (None, 0, None), (4, 0, 4), (5, 0, 5), (7, 3, 6), (7, 3, 6), (6, 3, 6)], key=str)
    assert ngram_join.ngram_components(df.limit(0)).count() == 0
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] or 0 for r in kept.collect())) == [0, 0, 4, 5, 6]


def brute_of_repeats(rows, k, percent):
    """component by doc_id where ids repeat: a doc_id is a node, and its texts' sets carry its links."""
    ids = {d for d, _ in rows}
    parent = {d: d for d in ids}
    sets = [(d, sets_of(t, k)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(parent, a), find(parent, b)))
                parent[q] = p
    return sorted((d, len(s), find(parent, d) if s else d) for d, s in sets)


def test_repeated_ids_with_other_texts_lose_no_link(spark):
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    a, b = (" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(2))
    rows = [(1, a), (1, b), (2, f"{a} x"), (3, f"{b} y"), (4, "")]
    for given in (rows, [(9 - d, t) for d, t in rows], [*rows, (3, ""), (3, None), (3, "-")]):
        got = ngram_join.ngram_components(spark.createDataFrame(given, "doc_id long, text string"), 5, 80)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_of_repeats(given, 5, 80)
    kept = ngram_join.one_of_each(spark.createDataFrame([*rows, (1, None), (1, "-"), (1, ""), (1, ""), (3, None), (1, a)], "doc_id long, text string"), 5, 80)
    assert sorted((r["doc_id"], str(r["text"])) for r in kept.collect()) == sorted([(1, a), (1, b), (1, ""), (1, "-"), (1, "None"), (3, "None"), (4, "")])


def test_random_repeats_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SATURATED", 5)
    rng = random.Random(12)
    texts = copies(rng, 6, 12, 30, 3)
    given = [(rng.randrange(45), t) for t in texts] + [(rng.randrange(45), "") for _ in range(5)]
    got = ngram_join.ngram_components(spark.createDataFrame(given, "doc_id long, text string").repartition(3), 4, 85)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_of_repeats(given, 4, 85)


def test_one_of_each(spark):
    rng = random.Random(5)
    some = copies(rng, 6, 30, 80, 2)
    rows = list(enumerate(some))
    want = {d for d, (n, c) in brute_components(rows, 5, 80).items() if c == d}
    df = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], DOCS)
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(df).collect()) == sorted(want)


def test_label_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, k) for k in range(2001, 2100)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        p, q = sorted((find(parent, a), find(parent, b)))
        parent[q] = p
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def distances_in(patterns, text):
    """Least edits of each of ``patterns``, all of one size, against any part of ``text``."""
    text, rows = np.frombuffer(text, np.uint8), np.array([np.frombuffer(p, np.uint8) for p in patterns])
    steps, cost = np.arange(len(text) + 1), np.zeros((len(rows), len(text) + 1), np.int64)
    for x in range(rows.shape[1]):
        new = cost + 1
        new[:, 1:] = np.minimum(new[:, 1:], cost[:, :-1] + (text != rows[:, x : x + 1]))
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
    return cost.min(1)


def fold(text):
    """Case apart; white space runs as one blank, other runs as three signs at most, periodic ones as 24."""
    b = re.sub(rb"[ \t\n\v\f\r]+", b" ", (text or "").encode().lower())
    b = re.sub(rb"([^ \0])\1{3,}", rb"\1\1\1", b)
    for period in range(2, 9):
        out, run = bytearray(), 0
        for x, c in enumerate(b):
            run = run + 1 if x >= period and c == b[x - period] else 0
            if run < 24:
                out.append(c)
        b = bytes(out)
    return b


def brute_leaks(docs, items, rule=decontaminate.EXCERPTS):
    out = set()
    for i, b in items:
        b = fold((b or "").strip())
        if len(b) < rule.q:
            if b:
                word = rb"[0-9a-z\x80-\xff]"
                out |= {(d, i) for d, t in docs if re.search(rb"(?<!%s)%s(?!%s)" % (word, re.escape(b), word), fold(t))}
            continue
        size, k, stretches = rule.windows(len(b))
        for d, t in docs:
            if distances_in([b[a : a + size] for starts in stretches for a in starts], fold(t)).min() <= k:
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(4, 30)))) for i in range(12)] + [(50, "short"), (51, None), (52, "ten chars!"), (53, "- " * 20), (54, "=" * 90), (55, " \n"), (56, "a,b"), (57, "qed")]
    docs = []
    for d in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 60)))
        part = list(items[d % 12][1])
        if d % 4 == 1:
            part = part[: int(len(part) * rng.uniform(0.6, 0.9))]
        for _ in range(rng.randint(0, max(1, len(part) // 14)) if d % 3 else 0):
            p = rng.randrange(len(part))
            part[p : p + rng.randint(0, 1)] = rng.choice(["", "é", "x", "xy"])
        at = rng.randint(0, len(text))
        docs.append((d, text[:at] + "".join(part).upper() + text[at:] if d % 5 else text))
    docs += [(100, None), (101, ""), (102, "ten  chars!"), (103, "TEN CHARS!"), (104, "é ten chars!"), (105, "- " * 1500), (106, "x == y, a,b. Q.E.D."), (107, "aa,b q QED! xqed"), (108, "\t" * 500 + "short" + "=" * 700)]
    ddf, bdf = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(ddf, bdf).collect()
    want = brute_leaks(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) and len(want) > 20
    clean = decontaminate.clean(ddf, bdf)
    assert clean.columns == ddf.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    at = {(r["doc_id"], r["item_id"]): (r["start"], r["end"]) for r in got}
    assert at[104, 52] == (2, 12)


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    items = [(i, f"this is the benchmark item number {i} of some") for i in range(4)]
    docs = [(i, "before " + t + " after", 1, 2, "x") for i, t in items]
    ddf, bdf = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(i, i) for i in range(4)} <= {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(ddf, bdf).collect()}
    assert decontaminate.clean(ddf, bdf).count() == 0
    assert decontaminate.leaks(ddf, bdf.limit(0)).count() == 0 and decontaminate.clean(ddf, bdf.limit(0)).count() == 4
    assert decontaminate.leaks(ddf.limit(0), bdf).count() == 0


def test_texts_shorter_than_the_items():
    rng = random.Random(9)
    items = ["".join(rng.choice("etaoinshr ") for _ in range(n)) for n in (900, 200, 300)]
    index = decontaminate.Index([0, 1, 2], [t.encode() for t in items])
    for text in (items[2][-120:], items[1][-100:], items[0][-80:], items[0][-5:], ""):
        assert all(fold(items[i]).endswith(fold(text)) for _, i, *_ in decontaminate._leaks(index, [text]))
    got = list(decontaminate._leaks(index, [items[0][-700:]]))
    assert [g[:3] for g in got] == [(0, 0, 0)]


def test_blanks_and_rules_on_both_sides_take_bounded_memory():
    """Runs are short once folded; of longer periods the shared q-grams are counted in parts."""
    items = [("-=" * 300 + f" item {i} " + " " * 900).encode() for i in range(300)]
    index = decontaminate.Index(list(range(300)), items)
    text = "-=" * 6000 + "\n" + " " * 8000 + "-" * 8000 + " item 7 " + "=-" * 3000
    tracemalloc.start()
    found = {i for _, i, *_ in decontaminate._leaks(index, [text])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == set(range(300)) and peak < 400 << 20, peak >> 20


def shares(item, text, size):
    return any(item[a : a + size] in text for a in range(len(item) - size + 1))


def test_excerpts_and_edited_words_leak():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    items = [some(rng.randint(12, 70)) for _ in range(16)] + ["ten chars!", "short", some(400)]
    texts, sure = [], []
    for i, t in enumerate(items[:16]):
        for share in (0.5, 0.6, 0.67, 0.75):
            size = int(np.ceil(share * len(t)))
            at = rng.randint(0, len(t) - size)
            texts.append(some(rng.randint(0, 20)) + t[at : at + size].upper() + some(rng.randint(0, 20)))
        words = t.split()
        for first in (0, 5, 9):
            texts.append(some(5) + " ".join(w if (k - first) % 10 else word() for k, w in enumerate(words)) + some(5))
            sure.append((len(texts) - 1, i))
        texts.append(some(60))
    texts += [some(30) + items[18][1000:1090] + some(30), "ten  chars!", "some TEN CHARS! here", "short"]
    found = {(n, i) for n, i, *_ in decontaminate._leaks(decontaminate.Index(list(range(len(items))), [t.encode() for t in items]), texts)}
    caught = [x in found for x in sure if len(items[x[1]].split()) >= 20]
    assert sum(caught) >= 0.9 * len(caught)
    assert {(len(texts) - 4, 18), (len(texts) - 3, 16), (len(texts) - 2, 16), (len(texts) - 1, 17)} <= found
    for n, t in enumerate(texts):
        for i, item in enumerate(items):
            if (n, i) not in found and len(item) > 80:
                assert not shares(item, t.lower(), int(np.ceil(min(90, max(45, len(item) / 2))))), (n, i)
    assert found == brute_leaks(list(enumerate(texts)), list(enumerate(items)))


def nearest_by_brute(vectors, every, k):
    ids = np.array([v for v, _ in vectors])
    x = np.array([e for _, e in vectors], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = u @ u[q]
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-round(s[i], 9), ids[i]))[:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_nearest_exact_when_small(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    vectors += [(1000 + i, vectors[10][1]) for i in range(30)] + [(2000, [2 * c for c in vectors[0][1]])]
    odd = [(5000, None), (5050, [0.0] * 8), (5100, [1.0] * 7 + [float("nan")]), (5150, [1.0] * 7 + [float("inf")]), (5200, [1.0] * 7 + [None]), (None, [1.0] * 8), (5250, [1.0, 2.0])]
    df = spark.createDataFrame([(v, e, 1) for v, e in vectors + odd], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    want = nearest_by_brute(vectors, 50, 5)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0, 0.0])], schema)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (0, [1.0, 0.0]), (3, [1e-30, 1e-30]), (2, [3e30, 3e30])], schema)).orderBy("rank").collect()
    one = [(0, 0, 1.0), (0, 2, round(0.5**0.5, 9)), (0, 3, round(0.5**0.5, 9))]  # of each of the two rows of id 0
    assert sorted((r["query_id"], r["vec_id"], round(r["score"], 9)) for r in got) == sorted(one * 2)
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.1])], schema)).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 4)) for r in got] == [(0, 1, 1, 0.995), (0, 2, 1, 0.0)]


def test_nearest_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    want = nearest_by_brute([(r["vec_id"], r["embedding"]) for r in rows], 50, 5)
    hit = sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in ann.nearest(df).collect())
    assert hit >= 0.9 * 5 * len(want)


def recall(spark, x, sampled=None):
    """Share of the true 5 nearest of (``sampled``) queries that are found among ids 0.. of float32 rows ``x``, and the prefixes they were met by."""
    got, prefixes = {}, set()
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        prefixes.add(r["prefix"])
    assert sorted(got) == list(range(0, len(x), 50)) and all(len(v) == 5 for v in got.values())
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit, asked = 0, sorted(got)[:: max(1, len(got) // (sampled or len(got)))]
    for q in asked:
        s = u @ u[q]
        assert np.allclose([s[v] for v, _ in got[q]], [c for _, c in got[q]], atol=1e-12)
        assert got[q] == sorted(got[q], key=lambda r: (-r[1], r[0])) and q not in dict(got[q])
        s[q] = -2
        hit += len(set(np.argpartition(-s, 5)[:5]) & dict(got[q]).keys())
    return hit / (5 * len(asked)), prefixes


@pytest.mark.parametrize("n", [5_000, 60_000])
def test_nearest_recall_at_sizes(spark, n):
    found, prefixes = recall(spark, np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32), 200)
    assert found >= 0.9 and (n < 60_000 or prefixes >= {1, 2})


def test_nearest_in_clusters(spark):
    rng = np.random.default_rng(8)
    spread = rng.choice([0.1, 0.2, 0.4, 0.7], size=(3000, 1))
    x = np.repeat(rng.normal(size=(3000, 64)), 20, axis=0) + np.repeat(spread, 20, axis=0) * rng.normal(size=(60_000, 64))
    found, prefixes = recall(spark, rng.permutation(x).astype(np.float32), 300)
    assert found >= 0.9 and len(prefixes) >= 5


def test_nearest_among_near_copies(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(3, 64))
    x = np.concatenate([base[0] + 0.03 * rng.normal(size=(4_000, 64)), base[1] + 1e-4 * rng.normal(size=(2_000, 64)), base[2] + rng.normal(size=(200, 64))])
    assert recall(spark, rng.permutation(x).astype(np.float32))[0] >= 0.9


def test_far_clusters_are_not_scored(monkeypatch):
    """Of tight clusters only a query's own is scored; a query with no near vector ascends as far as its promise asks."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(400, 32)), 25, axis=0) + 0.05 * rng.normal(size=(10_000, 32))
    length = np.sqrt((x * x).sum(1))
    keys = ann.strings(ann._unit(x, length))
    pairs = []
    monkeypatch.setattr(ann.Best, "add_pairs", lambda self, q, v, *rest, old=ann.Best.add_pairs: pairs.extend(zip(q.tolist(), v.tolist(), strict=True)) or old(self, q, v, *rest))
    best = ann.Best(x[::100], length[::100], 6)
    ann.Forest(keys).search(best, keys[::100], np.arange(len(x)), x, length)
    assert len(set(pairs)) < 100 * 200 and all(v // 25 == q * 4 for q, row in enumerate(best.cid.tolist()) for v in row)


def test_digits_agree_as_often_as_reckoned():
    rng = np.random.default_rng(10)
    x, z = rng.normal(size=(2, 3000, 48))
    y = 0.6 * x / np.linalg.norm(x, axis=1, keepdims=True) + 0.8 * z / np.linalg.norm(z, axis=1, keepdims=True)
    cosine = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    a, b = (ann.strings(ann._unit(v, np.linalg.norm(v, axis=1))) for v in (x, y))
    first = np.mean(a >> np.uint64(56) == b >> np.uint64(56))
    assert abs(first - np.mean(np.interp(cosine, *ann._odds()))) < 0.01


def test_nearest_keeps_what_single_precision_cannot_order():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 24))
    x[:400] = x[0] + 1e-6 * x[:400]  # cosines differ by less than the products' errors
    cid = np.arange(len(x))
    length = np.sqrt((x * x).sum(1))
    best = ann.Best(x[:20], length[:20], 6)
    for part in np.array_split(np.arange(len(x)), 7):
        best.add(cid[part], x[part], length[part])
    s = np.array([(x * q).sum(1) / (length * n) for q, n in zip(x[:20], length, strict=False)])
    assert best.cid.tolist() == [np.lexsort((cid, -row))[:6].tolist() for row in s]
