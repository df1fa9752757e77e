"""Secret scan: fixed formats, and strings that a battery of randomness tests can't tell from random ones.

A candidate is a long run of token characters. Its encoding is inferred from its characters. Against the hypothesis that it is random in that encoding
stand three tests: chi-squared uniformity of the alphabet, runs above and below the middle of the alphabet, and serial correlation. Against the
hypothesis that it is ordinary text stands the number of equal pairs of characters, which text has many of. Both are decided by the Benjamini-Hochberg
procedure in the candidate's class of lengths, over all candidates of the corpus: one is reported if randomness, by the battery's combined value, is
not rejected and ordinary text is. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.spans import count_of, in_order, joined, let, matches, spans

#: Formats looked for. Fixed values.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]
#: Candidates, and their encodings in order of preference: pattern, alphabet, chance of two equal characters in ordinary text.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [
    ("^[0-9]+$", _DIG, 0.16),
    ("^[0-9a-f]+$", _DIG + "abcdef", 0.11),
    ("^[0-9A-F]+$", _DIG + "ABCDEF", 0.11),
    ("^[a-z]+$", _LOW, 0.075),
    ("^[A-Z]+$", _UP, 0.075),
    ("^[A-Z2-7]+$", _UP + "234567", 0.075),
    ("^[A-Za-z]+$", _UP + _LOW, 0.065),
    ("^[A-Za-z0-9]+$", _UP + _LOW + _DIG, 0.06),
    ("", _UP + _LOW + _DIG + "+/-_", 0.06),
]
#: Lengths at which classes begin; share of false discoveries; letters of the smallest alphabet of which secrets are reported.
LENGTHS, RATE, SMALLEST = (20, 28, 36, 48, 64, 128), 0.01, 11
#: -ln(p) is counted in steps of 1 / STEPS, up to TOP steps.
STEPS, TOP = 10, 600


def _phi(z: Column) -> Column:
    """Normal distribution function, by a logistic form (error under 2e-4)."""
    z = F.greatest(F.least(z, F.lit(12.0)), F.lit(-12.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return 2 * _phi(-F.abs(z))


def _tests(x: Column) -> Column:
    """struct(start, end, class, text, random, wide) of a candidate (m, start, end): steps of its values against ordinary text and against randomness."""
    body = F.regexp_replace(x["m"], "=+$", "")
    size = F.length(body).cast("double")
    pick = lambda k: _chain([(body.rlike(e[0]), F.lit(e[k])) for e in ENCODINGS[:-1]], F.lit(ENCODINGS[-1][k]))
    alphabet, text_rate = pick(1), pick(2)
    first = F.struct(body.alias("b"), size.alias("n"), alphabet.alias("a"), F.length(alphabet).cast("double").alias("k"), text_rate.alias("t"), F.split(body, "").alias("c"))

    def more(s: Column) -> Column:
        squares = F.aggregate(F.array_distinct(s["c"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(s["c"], lambda y: y == c)).cast("double"), F.lit(2.0)))
        values = F.transform(s["c"], lambda c: F.call_function("instr", s["a"], c).cast("double") - (s["k"] + 1) / 2)
        return F.struct(s["n"].alias("n"), s["k"].alias("k"), s["t"].alias("t"), squares.alias("q"), values.alias("v"))

    def result(s: Column) -> Column:
        n, k, v = s["n"], s["k"], s["v"]
        chi = (k / n * s["q"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        steps = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("x"), F.slice(v, 2, F.size(v) - 1).alias("y"))
        high = F.size(F.filter(v, lambda y: y > 0)).cast("double")
        runs = 1 + F.size(F.filter(steps, lambda p: (p["x"] > 0) != (p["y"] > 0))).cast("double")
        mean = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25)))
        squares = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y)
        serial = F.aggregate(steps, F.lit(0.0), lambda acc, p: acc + p["x"] * p["y"]) / F.greatest(squares, F.lit(1e-9)) * F.sqrt(n)
        battery = 3 * F.least(1 - _phi(chi), _two_sided((runs - mean) / spread), _two_sided(serial))
        pairs, equal = n * (n - 1) / 2, (s["q"] - n) / 2
        p_text = _phi((equal - pairs * s["t"]) / F.sqrt(1.5 * pairs * s["t"] * (1 - s["t"])))
        steps_of = lambda p: F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-30))) * STEPS), F.lit(TOP)).cast("int")
        length = sum((F.when(n >= b, 1).otherwise(0) for b in LENGTHS[1:]), F.lit(0))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), length.cast("int").alias("class"), steps_of(p_text).alias("text"), steps_of(F.least(battery, F.lit(1.0))).alias("random"), (k >= SMALLEST).alias("wide"))

    return let(let(first, more), result)


def _chain(cases: list[tuple[Column, Column]], last: Column) -> Column:
    out = F.when(*cases[0])
    for c in cases[1:]:
        out = out.when(*c)
    return out.otherwise(last)


def _thresholds(scanned: DataFrame) -> dict[str, dict[int, int]]:
    """Of each hypothesis and class the least step that is rejected; from counts over all candidates, 2 * len(LENGTHS) * TOP rows at most."""
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"c.{h}").alias("step")) for h in ("text", "random")]))
    counts = scanned.select(F.explode("_found").alias("c")).select("c.class", each.alias("x")).groupBy("class", "x.h", "x.step").count().collect()
    out: dict[str, dict[int, int]] = {"text": {}, "random": {}}
    for h, found in out.items():
        for k in range(len(LENGTHS)):
            own = sorted(((r["step"], r["count"]) for r in counts if (r["h"], r["class"]) == (h, k)), reverse=True)
            total, below = sum(n for _, n in own), 0
            for step, n in own:
                below += n
                if math.exp(-step / STEPS) <= RATE * below / total:
                    found[k] = step
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end) and found (the method's own) for every row of ``docs`` (doc_id, text).

    Places are code points, end exclusive. A null text counts as empty; a null doc_id stays null; repeated rows are scanned each; other columns
    are ignored. Texts are read once; what they hold is written as a small table before thresholds are set over all of it. Time and memory of a very
    long text grow in proportion to its length and its matches.
    """
    text = F.coalesce("text", F.lit(""))
    assign = spans(matches(text, ASSIGN, 2), "assign", lambda x: F.length(x["g"]) >= LEAST["assign"])
    access = spans(matches(text, f"{ACCESS[:-1]}{{{LEAST['access'] - 4},}}"), "access", lambda x: F.lit(True))
    hexes = spans(matches(text, f"{HEX[:-1]}{{{LEAST['hex']},}}"), "hex", lambda x: F.lit(True))
    found = F.transform(matches(text, CANDIDATE), _tests)
    scanned = written(docs.select("doc_id", in_order(F.concat(assign, access, hexes), KINDS, True).alias("base"), found.alias("_found")), "secrets")
    least = {h: {k: F.lit(v) for k, v in steps.items()} for h, steps in _thresholds(scanned).items()}
    cut = lambda c, h: _chain([(c["class"] == k, least[h].get(k, F.lit(TOP + 1))) for k in range(len(LENGTHS))], F.lit(TOP + 1))
    picked = lambda c: c["wide"] & (c["random"] < cut(c, "random")) & (c["text"] >= cut(c, "text"))
    own = F.transform(F.filter("_found", picked), lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return scanned.select("doc_id", "base", own.alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and checksum of the base spans, and all spans."""
    base = F.col("base")
    return found.select(
        "doc_id",
        *[count_of(base, k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(in_order(F.concat("base", "found"), KINDS, True)).alias("spans"),
    )
