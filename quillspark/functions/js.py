"""JavaScript value semantics as Column expressions: white space, truthiness, numbers to text, fixed decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the language; differs from Java's. Fixed values.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Any character but a line end, and ASCII word boundaries.
ANY = r"[^\n\r\u2028\u2029]"
BOUND = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def collapsed(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def not_blank(c: Column) -> Column:
    return F.coalesce(trim(c) != "", F.lit(False))


def or_text(*cs: Column) -> Column:
    """a || b for strings: the first that is neither null nor empty, else the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs[:-1]], cs[-1])


def or_zero(c: Column) -> Column:
    """x || 0 for numbers: null and NaN become 0."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def number(c: Column) -> Column:
    """Text to a double; null where it is none."""
    return F.nullif(c, F.lit("")).try_cast("double")


def leading_number(c: Column) -> Column:
    """parseFloat(x) || 0: the number that the text begins with, or 0."""
    return F.coalesce(number(F.regexp_extract(c, f"^{WS}*([+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1)), F.lit(0.0))


def number_text(c: Column) -> Column:
    """A double as the language prints it, from 1e-6 to 1e21: no trailing zeros, no exponent."""
    plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,16)").cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    named = F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity")
    return F.when(c.isNotNull(), F.coalesce(named, F.when(c == 0, "0"), plain, c.cast("string")))


def fixed2(c: Column) -> Column:
    """toFixed(2): rounds the binary value exactly, ties away from zero."""
    x = c.cast("double")
    tie = F.pmod(F.abs(x) * 8, F.lit(2.0)) == 1.0
    rounded = F.when(tie, F.format_string("%.2f", x)).otherwise(F.replace(F.call_function("format_number", x, F.lit("0.00")), F.lit(","), F.lit("")))
    return F.when(F.isnan(x), "NaN").otherwise(rounded)


def rounded2(c: Column) -> Column:
    """Math.round(x * 100) / 100: halves go up; what is not finite becomes 0."""
    x = c.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(ok, F.floor(x * 100 + 0.5) / 100).otherwise(0.0)


def grouped_text(c: Column) -> Column:
    """toLocaleString in English: thousands separated, at most three decimals."""
    return F.call_function("format_number", F.round(c.cast("double"), 3), F.lit("#,##0.###"))


def divided(n: Column, d: Column) -> Column:
    """n / d of doubles without errors: x / 0 is infinite, 0 / 0 is NaN."""
    return F.when(d != 0, n / d).when(n == 0, float("nan")).when(n > 0, float("inf")).otherwise(float("-inf"))


def hypot(x: Column, y: Column) -> Column:
    """Math.hypot of two numbers."""
    return F.sqrt(x * x + y * y)
