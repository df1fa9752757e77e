"""Personal data: fixed formats, and candidates that boosted trees select by format and context.

High-recall generators propose overlapping spans. Boosted trees of depth two, trained in numpy on a bounded sample of candidates, score what the
spans and the characters around them look like; the formats' own checks (checksums, ranges) are not among the features. No table labels personal
data, so the sample is widened: what a fixed format accepts is a positive and is also written in shapes that no format accepts (numbers without
their plus, cards with a wrong digit, accented addresses); what none accepts is a negative, and every candidate is also written as a decoy of its
generator (dates, amounts, ranges of years, runs of digits; hosts without a dot, paths). Spans of one text stay on one side of a held-out fifth,
on which each generator's threshold is calibrated: the highest recall with a precision of at least PRECISION. Scores are DataFrame expressions of the
trees. Spelled-out addresses (name [at] host [dot] com) are all reported: written out, each is an address by its format.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import written
from quillspark.llm.spans import count_of, in_order, joined, let, matches, running, spans

#: Formats looked for, in the possessive forms that need no deep recursion on long runs of digits. Fixed values.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
KINDS = ["email", "ip", "card", "phone"]
#: Generators of candidates and the prefix of the kinds they add.
GENERATORS = {
    "address": r"[^\s@<>,;|]{1,64}@[^\s@<>,;|]{2,255}",
    "number": r"\+?[0-9(][0-9 ().\-/]{5,40}[0-9]",
    "spelled": r"[A-Za-z0-9._-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,64} ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,12}",
}
#: Generators whose every candidate the e-mail format accepts once its signs are written out: they need no score, and no format gives them positives.
CERTAIN = ("spelled",)
FEATURES = (
    "length", "digits", "letters", "separators", "dots", "plus", "spaces", "digit_before", "letter_before", "keyword", "letter_after", "digit_after", "address", "number",
    "groups", "last_group", "bracket", "marks", "domain_dots",
)
#: Words before personal data. Fixed values.
KEYWORD = "(?i)(mail|phone|tel|call|card|ip|fax|contact|mobile|ssn)[^a-z]*$"
#: Rows to train on at most, a third of them candidates as they stand; trees, whose depth is two; least precision on held-out rows; one row in FOLDS is held out.
SAMPLE, TREES, RATE, PRECISION, FOLDS = 20_000, 30, 0.3, 0.9, 5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    n = F.length(s)
    digits = F.split(s, "")
    total = F.aggregate(F.transform(digits, lambda c, i: F.struct(F.try_to_number(c, F.lit("9")).cast("int").alias("d"), (F.pmod(n - i, F.lit(2)) == 0).alias("twice"))), F.lit(0), lambda acc, x: acc + F.when(x["twice"], F.when(x["d"] > 4, 2 * x["d"] - 9).otherwise(2 * x["d"])).otherwise(x["d"]))
    return F.pmod(total, F.lit(10)) == 0


def _base(text: Column) -> Column:
    card_ok = lambda x: F.when(F.length(_digits(x["m"])).between(13, 19), _luhn(_digits(x["m"]))).otherwise(F.lit(False))
    return F.concat(
        F.when(text.contains("@"), spans(matches(text, EMAIL), "email", lambda x: F.lit(True))).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")),
        spans(matches(text, IP), "ip", lambda x: x["m"].rlike(OCTETS)),
        spans(matches(text, CARD), "card", card_ok),
        F.when(text.contains("+"), spans(matches(text, PHONE), "phone", lambda x: F.length(_digits(x["m"])).between(9, 15))).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")),
    )


def _features(g: Column, m: Column, before: Column, after: Column) -> list[Column]:
    size = lambda pattern: F.length(F.regexp_replace(m, pattern, "")).cast("double")
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = {
        "length": F.length(m).cast("double"),
        "digits": size("[^0-9]"),
        "letters": size("[^A-Za-z]"),
        "separators": size(r"[^ ().\-/]"),
        "dots": size(r"[^.]"),
        "plus": yes(m.startswith("+")),
        "spaces": size("[^ ]"),
        "digit_before": yes(before.rlike("[0-9]$")),
        "letter_before": yes(before.rlike(r"\p{L}$")),
        "keyword": yes(before.rlike(KEYWORD)),
        "letter_after": yes(after.rlike(r"^\p{L}")),
        "digit_after": yes(after.rlike("^[0-9]")),
        "address": yes(g == "address"),
        "number": yes(g == "number"),
        "groups": F.length(F.regexp_replace(F.regexp_replace(m, "[0-9]++", "#"), "[^#]", "")).cast("double"),
        "last_group": F.length(F.regexp_extract(m, "([0-9]*)$", 1)).cast("double"),
        "bracket": yes(m.contains("(")),
        "marks": size(r"[\p{L}0-9._%+@\-]"),
        "domain_dots": F.length(F.regexp_replace(F.regexp_extract(m, "@(.*)$", 1), r"[^.]", "")).cast("double"),
    }
    return [values[k].alias(k) for k in FEATURES]


def _candidates(text: Column) -> Column:
    """array of struct(g, start, end, m, before, after, one field for each feature)."""

    def described(name: str):
        def one(x: Column) -> Column:
            return F.struct(F.lit(name).alias("g"), *[x[k].alias(k) for k in ("start", "end", "m", "before", "after")], *_features(F.lit(name), x["m"], x["before"], x["after"]))

        return one

    return F.concat(*[F.transform(matches(text, p), described(g)) for g, p in GENERATORS.items()])


def _one_of(key: Column, *choices: Column) -> Column:
    return F.get(F.array(*choices), F.pmod(F.xxhash64(key), F.lit(len(choices))).cast("int"))


def _reshaped(g: Column, m: Column) -> Column:
    """A candidate that a format accepts in a shape that none does, picked by a hash of its text; null if it has none."""
    digits = _digits(m)
    national = F.regexp_replace(m, r"^\+[0-9]{1,3}[ .\-]?", "")
    bare = F.regexp_replace(national, "[()]", "")
    phone = _one_of(m, F.regexp_replace(m, r"^\+", ""), F.regexp_replace(m, r"^\+", "00"), national, F.regexp_replace(bare, r"[ .\-]+", "-"), F.regexp_replace(bare, r"[ .\-]+", "."))
    mistyped = F.concat(F.left(digits, F.length(digits) - 1), F.translate(F.right(digits, F.lit(1)), "0123456789", "1234567890"))
    card = F.regexp_replace(mistyped, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), _one_of(m, F.lit("-"), F.lit(" "))))
    return F.when(g == "address", _one_of(m, F.regexp_replace(m, "[aeiou](?=[^@]*@)", "é"), F.regexp_replace(m, "(@[^@]*?)[aeiou]", "$1é"))).when(m.startswith("+"), phone).when(F.length(digits).between(13, 19), card)


def _decoy(g: Column, m: Column) -> Column:
    """A candidate's signs in a shape that is no personal data, picked by a hash of its text."""
    d = F.rpad(_digits(m), 8, "0")
    cut = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else F.substring(d, *x) for x in parts])
    number = _one_of(
        m,
        cut((1, 4), "-", (5, 2), "-", (7, 2)), cut((1, 2), ".", (3, 2), ".", (5, 4)), cut((1, 2), "/", (3, 2), "/", (5, 4)),
        cut((1, 1), " ", (2, 3), ".", (5, 2)), cut((1, 1), " ", (2, 3), " ", (5, 3)), cut((1, 1), ".", (2, 7)), cut((1, 4), "-", (5, 4)), cut((1, 8)), cut((1, 7)),
    )
    address = _one_of(m, *[F.regexp_replace(m, r"\.(?=[^@]*$)", x) for x in ("", ":", "/")])
    return F.when(g == "address", address).otherwise(number)


def _flagged(base: Column, candidates: Column) -> Column:
    """The candidates with ``inside``, whether they overlap a base span, and ``fresh``, whether they equal none; one sort, no loop of all by all."""
    none = F.lit(None)

    def merged(b: Column, c: Column) -> Column:
        span = lambda x, kind, c: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("candidate"), c.alias("c"))
        own = F.transform(c, lambda x: span(x, 1, x))
        return F.array_sort(F.concat(own, F.transform(b, lambda x: span(x, 0, F.when(F.lit(False), F.get(c, F.lit(0))).otherwise(none)))))

    def bounds(z: Column) -> Column:
        left = running(F.transform(z, lambda x: F.when(x["candidate"] == 0, x["end"]).otherwise(F.lit(0).cast("bigint"))), 0, F.greatest)
        far = F.lit(1 << 40).cast("bigint")
        right = F.reverse(running(F.reverse(F.transform(z, lambda x: F.when(x["candidate"] == 0, x["start"]).otherwise(far))), 1 << 40, F.least))
        return F.struct(z.alias("z"), left.alias("left"), right.alias("right"))

    def flags(s: Column) -> Column:
        z = s["z"]

        def one(x: Column, i: Column) -> Column:
            # of equal spans the base comes first, so it is at most as many places ahead as there are generators
            others = [F.get(z, i - k) for k in range(1, len(GENERATORS) + 1)]
            equal = lambda y: F.coalesce((y["candidate"] == 0) & (y["start"] == x["start"]) & (y["end"] == x["end"]), F.lit(False))
            same = equal(others[0])
            for y in others[1:]:
                same = same | equal(y)
            inside = (F.get(s["left"], i) > x["start"]) | (F.get(s["right"], i) < x["end"])
            return F.struct(x["candidate"].alias("candidate"), x["c"].alias("c"), inside.alias("inside"), (~same).alias("fresh"))

        found = F.filter(F.transform(z, one), lambda x: x["candidate"] == 1)
        return F.transform(found, lambda x: F.struct(*[x["c"][k].alias(k) for k in ("g", "start", "end", "m", "before", "after", *FEATURES)], x["inside"].alias("inside"), x["fresh"].alias("fresh")))

    return let(F.struct(base.alias("b"), candidates.alias("c")), lambda s: let(let(merged(s["b"], s["c"]), bounds), flags))


@dataclass
class Trees:
    """Boosted trees of depth two: (feature, cut, left (feature, cut, value, value), right) with a start value; thresholds, and precision and recall on held-out rows, by generator."""

    start: float
    trees: list[tuple]
    least: dict[str, float]
    held_out: dict[str, tuple[float, float]]

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, c, left, right in self.trees:
            low = x[:, f] <= c
            for side, (g, d, a, b) in ((low, left), (~low, right)):
                total += np.where(side, np.where(x[:, g] <= d, a, b), 0.0)
        return total

    def column(self, c: Column) -> Column:
        total = F.lit(self.start)
        for f, cut, left, right in self.trees:
            leaf = lambda s: F.when(c[FEATURES[s[0]]] <= s[1], s[2]).otherwise(s[3])
            total = total + F.when(c[FEATURES[f]] <= cut, leaf(left)).otherwise(leaf(right))
        return total


def _split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> tuple[int, float, float]:
    """(feature, cut, gain) of the best split; ties go to the first feature."""
    best, whole = (0, np.inf, 0.0), grad.sum() ** 2 / (hess.sum() + 1)
    for f in range(x.shape[1]):
        for c in np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25), method="lower")):
            low = x[:, f] <= c
            gain = grad[low].sum() ** 2 / (hess[low].sum() + 1) + grad[~low].sum() ** 2 / (hess[~low].sum() + 1) - whole
            if gain > best[2] + 1e-9:
                best = (f, float(c), float(gain))
    return best


def calibrated(score: np.ndarray, y: np.ndarray) -> tuple[float, float, float] | None:
    """(threshold, precision, recall): of the thresholds with at least PRECISION the one of highest recall, and where none has it the one of
    the best harmonic mean of the two (redaction rather errs towards more). It lies midway to the next lower score. None without positives."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)  # equal scores pass together
    if not y.any():
        return None
    precision, recall = hits / np.arange(1, len(s) + 1), hits / hits[-1]
    good = np.flatnonzero(last & (precision >= PRECISION))
    k = good[-1] if len(good) else int(np.argmax(np.where(last, precision * recall / np.maximum(precision + recall, 1e-9), 0)))
    return float(s[k] + s[min(k + 1, len(s) - 1)]) / 2, float(precision[k]), float(recall[k])


def fit(x: np.ndarray, y: np.ndarray, generators: list[str], held: np.ndarray | None = None, trees: int = TREES) -> Trees:
    """Newton boosting of the logistic loss on the rows that are not ``held``, on which thresholds are calibrated.

    A generator whose held-out rows lack a class is calibrated on all its rows. Without both classes to learn from nothing is selected.
    """
    held = np.zeros(len(y), bool) if held is None else held
    if len(np.unique(y[~held])) < 2:
        held = np.zeros(len(y), bool)
    if len(np.unique(y)) < 2:
        return Trees(0.0, [], {}, {})
    learnt, truth = x[~held], y[~held]
    start = float(np.log(truth.mean() / (1 - truth.mean())))
    model = Trees(start, [], {}, {})
    score = np.full(len(truth), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = truth - p, p * (1 - p)
        f, c, gain = _split(learnt, grad, hess)
        if gain <= 1e-6:
            break
        leaves = []
        for side in (learnt[:, f] <= c, learnt[:, f] > c):
            g, d, _ = _split(learnt[side], grad[side], hess[side])
            low = learnt[side][:, g] <= d
            value = [RATE * float(grad[side][k].sum() / (hess[side][k].sum() + 1)) for k in (low, ~low)]
            leaves.append((g, d if np.isfinite(d) else 1e300, *value))
        model.trees.append((f, c, leaves[0], leaves[1]))
        score = model.raw(learnt)
    kinds, score = np.array(generators), model.raw(x)
    for g in sorted(set(generators)):
        own = (kinds == g) & held
        own = own if len(np.unique(y[own])) == 2 else kinds == g
        if found := calibrated(score[own], y[own]):
            model.least[g], model.held_out[g] = found[0], found[1:]
    return model


def train(found: DataFrame, limit: int = SAMPLE) -> Trees:
    """Fit on at most ``limit`` rows: a third are candidates, picked by a hash of their document and place, the others their shapes and decoys."""
    found = found.select("doc_id", F.explode("_found").alias("c")).filter(~F.col("c.g").isin(*CERTAIN))
    n = found.count()
    share = int(1e6 * min(1.0, 0.9 * (limit // 3) / max(1, n)))
    picked = found.filter(F.pmod(F.xxhash64("doc_id", "c.start", "c.g"), F.lit(1_000_000)) < share).select("c.*").limit(limit // 3)
    g, m, inside = F.col("g"), F.col("m"), F.col("inside")
    row = lambda text, before, y: F.struct(text.alias("m"), before.alias("before"), y.cast("int").alias("y"))
    versions = F.array(row(m, F.col("before"), inside), row(F.when(inside, _reshaped(g, m)), F.col("before"), F.lit(1)), row(_decoy(g, m), F.regexp_replace("before", KEYWORD, " "), F.lit(0)))
    whole = F.lit(False)
    for name, pattern in GENERATORS.items():
        whole = whole | ((g == name) & F.col("v.m").rlike(f"^(?:{pattern})$"))
    held = F.pmod(F.xxhash64("m"), F.lit(FOLDS)) == 0
    rows = picked.select("g", "after", held.alias("held"), F.explode(versions).alias("v")).filter(whole).select("g", *_features(g, F.col("v.m"), F.col("v.before"), F.col("after")), "v.y", "held").collect()
    rows = sorted(map(tuple, rows))  # the order of arrival is not fixed
    x = np.array([r[1:-2] for r in rows], np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array([r[-2] for r in rows], np.float64), [r[0] for r in rows], np.array([r[-1] for r in rows], bool))


def proposed(docs: DataFrame) -> DataFrame:
    """doc_id, base and _found, the generators' candidates with their features, for every row of ``docs``; written."""
    text = F.coalesce("text", F.lit(""))
    own = let(F.struct(_base(text).alias("b"), _candidates(text).alias("c")), lambda s: F.struct(in_order(s["b"], KINDS, False).alias("base"), _flagged(s["b"], s["c"]).alias("_found")))
    return written(docs.select("doc_id", own.alias("x")).select("doc_id", "x.base", "x._found"), "pii")


def selected(found: DataFrame, model: Trees) -> DataFrame:
    """doc_id, base and found: the candidates of :func:`proposed` that reach their generator's threshold and equal no base span."""
    picked = lambda c: c["fresh"] & (c["g"].isin(*CERTAIN) | (model.column(c) >= _least(c["g"], model.least, F.lit(float("inf")))))
    own = F.transform(F.filter("_found", picked), lambda c: F.struct(F.concat(F.lit("maybe_"), c["g"]).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.select("doc_id", "base", own.alias("found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end) and found (the method's own, of kind maybe_<generator>) for every row of ``docs`` (doc_id, text).

    Places are code points, end exclusive. Candidates that equal a base span are left to it. A null text counts as empty; a null doc_id stays null;
    repeated rows are scanned each; other columns are ignored. Texts are read once; what they hold is written before trees are trained. Time and
    memory of a very long text grow in proportion to its length and its matches (but for a sort).
    """
    found = proposed(docs)
    return selected(found, train(found))


def _least(g: Column, least: dict[str, float], other: Column) -> Column:
    out = other
    for k, v in least.items():
        out = F.when(g == k, v).otherwise(out)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts and checksum of the base spans, and all spans."""
    kinds = [*KINDS, *[f"maybe_{g}" for g in GENERATORS]]
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(in_order(F.concat("base", "found"), kinds, False)).alias("spans"),
    )
