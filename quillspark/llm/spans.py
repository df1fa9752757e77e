"""Places of regular-expression matches as DataFrame expressions, in time and memory that grow with the text.

``split`` gives the pieces between matches and ``regexp_extract_all`` the matches; running sums of their lengths give every place in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:bigint,end:bigint>"
#: Elements that one fold appends to its result: appending copies what is there, so longer arrays are folded in blocks.
BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is evaluated once however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, zero: int, merge: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: of each element of ``values`` (array<bigint>) what ``merge``, which is associative, makes of ``zero`` and all elements before it."""
    none, start = F.array().cast("array<bigint>"), F.lit(zero).cast("bigint")

    def fold(part: Column, at: Column) -> Column:
        step = lambda acc, x: F.struct(merge(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(v) <= BLOCK, fold(v, start)).otherwise(let(cut, whole))

    def whole(cut: Column) -> Column:
        ahead = fold(F.transform(cut, lambda part: F.aggregate(part, start, lambda acc, x: merge(acc, x))), start)
        return F.flatten(F.zip_with(cut, ahead, fold))

    return let(values, blocks)


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array of struct(m, g, start, end, before, after) of all matches, leftmost and not overlapping; g is a group's text, before and after are the pieces beside the match."""
    kind = "array<struct<m:string,g:string,start:bigint,end:bigint,before:string,after:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    groups = F.regexp_extract_all(text, F.lit(pattern), group) if group else F.lit(None).cast("array<string>")

    def places(s: Column) -> Column:
        n, m = F.size(s["m"]), s["m"]
        at = running(F.zip_with(F.slice(s["p"], 1, n), m, lambda b, x: (F.length(b) + F.length(x)).cast("bigint")), 0, lambda x, y: x + y)
        return F.arrays_zip(m.alias("m"), (s["g"] if group else m).alias("g"), F.slice(s["p"], 1, n).alias("b"), F.slice(s["p"], 2, n).alias("a"), at.alias("at"))

    def one(x: Column) -> Column:
        start = x["at"] + F.length(x["b"])
        return F.struct(x["m"].alias("m"), x["g"].alias("g"), start.alias("start"), (start + F.length(x["m"])).alias("end"), F.right(x["b"], F.lit(16)).alias("before"), F.left(x["a"], F.lit(8)).alias("after"))

    parts = F.struct(found.alias("m"), groups.alias("g"), F.split(text, pattern, -1).alias("p"))
    return F.when(text.rlike(pattern), F.transform(let(parts, places), one).cast(kind)).otherwise(F.array().cast(kind))


def spans(found: Column, kind: str, keep: Callable[[Column], Column]) -> Column:
    """array of struct(kind, start, end) of the matches that ``keep`` accepts."""
    return F.transform(F.filter(found, keep), lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def joined(array: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def in_order(array: Column, kinds: list[str], start_first: bool) -> Column:
    """Spans sorted by start and then kind as listed in ``kinds``, or the other way round."""
    place = lambda x: F.array_position(F.array(*map(F.lit, kinds)), x["kind"]).alias("k")
    key = lambda x: F.struct(x["start"].alias("s"), place(x), x["end"].alias("e"), x["kind"].alias("n")) if start_first else F.struct(place(x), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("n"))
    return F.transform(F.array_sort(F.transform(array, key)), lambda x: F.struct(x["n"].alias("kind"), x["s"].alias("start"), x["e"].alias("end")))


def count_of(array: Column, kind: str) -> Column:
    return F.size(F.filter(array, lambda x: x["kind"] == kind)).cast("bigint")
