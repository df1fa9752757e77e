import random
import re

import pytest

from quillspark.operators import phrases
from quillspark.operators.drawing import FIELDS, FINISHES, MATERIALS, NOTES, classify, classify_listed, dictionary
from quillspark.operators.phrases import ANYWHERE, WORDS, found
from tests.test_drawing import GOLDEN

DICTIONARY = "list string, rule string, phrase string, place int"


def by_loops(texts, entries):
    """{(key, list): (phrase, place, n_phrases, n_found)} by regular expressions and slices."""
    out = {}
    for key, t in texts:
        for name in {e[0] for e in entries}:
            least, n = {}, {}
            for _, rule, p, place in (e for e in entries if e[0] == name and e[2]):
                p = p.lower()
                if rule == WORDS:
                    hits = len(re.findall(rf"(?=\b{r'\s+'.join(map(re.escape, p.split()))}\b)", t or "", re.I | re.A))
                    # white space before or behind a word is one place, so hits are its starts
                else:
                    low = (t or "").lower()
                    hits = sum(low.startswith(p, k) for k in range(len(low)))
                if hits:
                    least[rule, p], n[rule, p] = min(place, least.get((rule, p), place)), hits
            if n:
                merged = {}
                for (_, p), place in least.items():
                    merged[p] = min(place, merged.get(p, place))
                place, p = min((place, p) for p, place in merged.items())
                out[key, name] = (p, place, len(merged), sum(n.values()))
    return out


def as_dict(df):
    return {(r["k"], r["list"]): (r["phrase"], r["place"], r["n_phrases"], r["n_found"]) for r in df.collect()}


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_found_equals_loops(spark, piece):
    rng = random.Random(piece)
    words = ["ab", "abc", "b", "a", "ab-c", "zinc", "Zinc", "plate", "plated", "x_1", "é", "😀", "u.o.s", "uos"]
    entries = [("w", WORDS, " ".join(rng.choices(words[:10], k=rng.randint(1, 3))), rng.randrange(9)) for _ in range(60)]
    entries += [("s", ANYWHERE, rng.choice([" ", "", "-"]).join(rng.choices(words, k=rng.randint(1, 3))), rng.randrange(9)) for _ in range(60)]
    entries += [("w", WORDS, "", 0), ("w", WORDS, None, 0), ("s", ANYWHERE, "", 0), entries[0]]
    texts = [(k, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t\n", "", ", ", "é", "_"]) for _ in range(rng.randint(0, 30)))) for k in range(200)] + [(900, None), (901, ""), (902, " ")]
    got = as_dict(found(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(entries, DICTIONARY), ["k"], piece=piece))
    assert got == by_loops(texts, entries) and len(got) > 200


def test_ten_thousand_phrases(spark):
    rng = random.Random(5)
    entries = [(rng.choice("pq"), WORDS, f"part {k % 5000} of {k % 7}", k) for k in range(10_000)]
    texts = [(k, f"PART  {rng.randrange(6000)} of {rng.randrange(9)}, part {rng.randrange(6000)} of {rng.randrange(9)}x") for k in range(300)]
    inside = {(name, p): min(e[3] for e in entries if e[0] == name and e[2] == p) for name, p in {(e[0], e[2]) for k, t in texts for e in entries if e[2] == " ".join(t.lower().split(",")[0].split())}}
    want = {(k, name): (p, inside[name, p], 1, 1) for k, t in texts for name in "pq" if (name, p := " ".join(t.lower().split(",")[0].split())) in inside}
    assert as_dict(found(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(entries, DICTIONARY), ["k"])) == want and want


@pytest.mark.parametrize("sent", [0, 100_000])
def test_pieces_end_with_runs_and_any_white_space_is_one(spark, monkeypatch, sent):
    monkeypatch.setattr(phrases, "SENT", sent)
    entries = [("w", WORDS, p, k) for k, p in enumerate(["a b", "b c", "zinc", "a", "c!", "!", "zinc plate a"])] + [("s", ANYWHERE, "c p", 1)]
    rng, glue = random.Random(3), [" ", "  ", " \u00a0\u2003\n", "\ufeff", "\u200b", "! ", "-" * 5000, " " * 5000]
    texts = [(k, "".join(rng.choice(["a", "B", "c", "ZINC", "plate", "x" * 5000]) + rng.choice(glue) for _ in range(40))) for k in range(40)] + [(k, "zinc plate a b" * 3000 + "a b " * k) for k in range(100, 105)]
    got = as_dict(found(spark.createDataFrame(texts, "k int, text string"), spark.createDataFrame(entries, DICTIONARY), ["k"]))
    spaced = [(k, re.sub("[\\s\ufeff]+", " ", t)) for k, t in texts]  # its white space is Python's and the mark
    words = [e for e in entries if e[1] == WORDS]
    assert {k: v for k, v in got.items() if k[1] == "w"} == by_loops(spaced, words)
    assert {k: v for k, v in got.items() if k[1] == "s"} == by_loops(texts, [entries[-1]])


def test_texts_of_one_task_are_dealt_and_cut_into_runs_once(spark, tmp_path):
    spark.createDataFrame([(k, "Zinc plate") for k in range(50)], "k int, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    plan = found(texts, spark.createDataFrame([("f", WORDS, "zinc", 4)], DICTIONARY), ["k"])._jdf.queryExecution().executedPlan().toString()
    lines = [re.sub(r"#\d+L?", "", line) for line in plan.splitlines()]
    dealt = next(k for k, line in enumerate(lines) if "RoundRobinPartitioning" in line)
    cut = [k for k, line in enumerate(lines) if "regexp_extract_all(concat(" in line]
    assert len(cut) == 1 and cut[0] < dealt and any("FileScan" in line for line in lines[dealt + 1 : dealt + 4])
    assert lines[cut[0]].count("regexp_extract_all(concat(") == 1


def test_long_texts_rows_of_a_key_and_empty_tables(spark):
    long = "zinc plate " * 100_000
    texts = spark.createDataFrame([(None, long, 1), (None, "zinc", 2), (2, "nothing", 3)], "k int, text string, list int")
    entries = spark.createDataFrame([("f", WORDS, "Zinc  Plate", 3), ("f", WORDS, "zinc", 4), ("a", ANYWHERE, "c p", 1)], DICTIONARY)
    assert as_dict(found(texts, entries, ["k"])) == {(None, "f"): ("zinc plate", 3, 2, 200_001), (None, "a"): ("c p", 1, 1, 100_000)}
    assert found(texts, entries.limit(0), ["k"]).collect() == [] == found(texts.limit(0), entries, ["k"]).collect()
    assert found(texts, entries.limit(0), ["k"]).dtypes == found(texts, entries, ["k"]).dtypes
    with pytest.raises(ValueError, match="keys"):
        found(texts, entries, ["list"])
    with pytest.raises(Exception, match="no rule: none"):
        found(texts, spark.createDataFrame([("f", "none", "x", 1)], DICTIONARY), ["k"]).collect()


def test_listed_classes_equal_the_fixed_ones(spark):
    rng = random.Random(9)
    every = [*FINISHES, *MATERIALS, *NOTES]
    texts = [g[0] for g in GOLDEN] + every + [rng.choice(["", "2 ", "x", "1. "]) + rng.choice([" ", "  ", "-", "", "s "]).join(rng.sample(every, rng.randint(1, 3))) for _ in range(300)]
    texts += [t.upper() for t in texts[-200:]]
    items = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    columns = ["i", "category", "type", *FIELDS]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(classify_listed(items, dictionary(spark))) == rows(classify(items))
    more = dictionary(spark).unionByName(spark.createDataFrame([("materials", WORDS, "unobtainium", 99)], DICTIONARY))
    row = classify_listed(spark.createDataFrame([("Unobtainium bar",)], "text string"), more).head()
    assert (row["category"], row["value_str"]) == ("materials", "Unobtainium bar")
