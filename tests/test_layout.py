import random

from pyspark.sql import functions as F

from quillspark.operators import layout


def width(text):
    return sum(layout.WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else layout.OTHER for c in text)


def by_loops(text, points):
    limit, out = points * 1000 / 12, []
    for paragraph in (text or "").replace("\r\n", "\n").split("\n") if text else []:
        line = None
        for word in paragraph.split(" "):
            used = 0 if line is None else width(line) + 278
            if used + width(word) <= limit:
                line = word if line is None else f"{line} {word}"
            elif width(word) <= limit:
                out.append(line)
                line = word
            else:
                pieces, cur, first = [], "", limit - used
                for c in word:
                    if width(cur + c) >= first if not pieces else width(cur + c) > limit:
                        pieces.append(cur)
                        cur = ""
                    cur += c
                pieces.append(cur)
                out += [pieces[0] if line is None else f"{line} {pieces[0]}", *pieces[1:-1]]
                line = pieces[-1]
        out.append(line)
    return out


def test_wrapping_equals_loops(spark):
    rng = random.Random(1)
    words = ["a", "", "iii", "Wide", "é€", "MMMMMMMM", "x" * 30, "line\n", "\r\n\r\n", "tab\t", "~|{}", "W" * 70]
    texts = [None, "", " ", "\n", "W" * 40, *(" ".join(rng.choice(words) for _ in range(rng.randint(1, 25))) for _ in range(200))]
    for points in (60, 200):
        got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", layout.wrapped(F.col("t"), points).alias("l"), layout.text_width(F.col("t")).alias("w")).collect()
        for r in got:
            assert r["l"] == by_loops(texts[r["k"]], points), texts[r["k"]]
            assert r["w"] == (None if texts[r["k"]] is None else width(texts[r["k"]]))


def test_heights_and_blocks(spark):
    lines = lambda n: F.array(*[F.lit("x")] * n) if n else F.array().cast("array<string>")
    row = spark.range(1).select(
        layout.row_height(lines(0)).alias("none"), layout.row_height(lines(3)).alias("three"),
        layout.closing_blocks(F.lit(2), F.lit(100.0), lines(2), lines(1), 48, 792).alias("both"), layout.closing_blocks(F.lit(1), F.lit(680.0), lines(1), lines(0), 48, 792).alias("low"), layout.closing_blocks(F.lit(1), F.lit(640.0), lines(5), lines(1), 48, 792).alias("over"), layout.closing_blocks(F.lit(1), F.lit(1.0), lines(0), lines(0), 48, 792).alias("empty"),
    ).head()
    assert (row["none"], row["three"], row["empty"]) == (24.0, 72.0, [])
    assert [(b["kind"], b["page"], b["y"]) for b in row["both"]] == [("TERMS", 2, 116.0), ("NOTES", 2, 166.0)]
    assert [(b["kind"], b["page"], b["y"]) for b in row["low"]] == [("TERMS", 2, 48.0)]
    assert [(b["kind"], b["page"], b["y"]) for b in row["over"]] == [("TERMS", 1, 656.0), ("NOTES", 2, 48.0)]
