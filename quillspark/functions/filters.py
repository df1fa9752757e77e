"""Store filters, given as documents, as conditions: equality, ``$regex`` and the empty filter. What a regex begins with reaches the scan as a prefix."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_MARKS = set(".^$*+?()[]{}|\\")


def literal(text: str) -> str:
    """A regex that means ``text`` itself."""
    return "".join(f"\\{c}" if c in _MARKS else c for c in text)


def starting_with(field: str, prefix: str) -> dict:
    """The filter of values that begin with ``prefix``, whose marks are literal."""
    return {field: {"$regex": f"^{literal(prefix)}"}}


def literal_prefix(regex: str) -> tuple[str, bool]:
    """What every match of an anchored regex begins with, and whether that is all it asks for; no prefix where it is not anchored or has alternatives."""
    if not regex.startswith("^") or "|" in regex.replace("\\|", "").replace("\\\\", ""):
        return "", False
    out, k = [], 1
    while k < len(regex):
        c = regex[k]
        if c == "\\" and k + 1 < len(regex) and not regex[k + 1].isalnum():
            out.append(regex[k + 1])
            k += 2
        elif c in _MARKS:
            break
        else:
            out.append(c)
            k += 1
    if k < len(regex) and regex[k] in "*?{" and out:
        out.pop()  # the last character may be missing
    return "".join(out), k == len(regex)


def condition(document: str | dict | None) -> Column:
    """The condition of a filter document, as JSON or a dict: all its fields have to fit. Null and {} let everything through.

    A field's value is what it has to equal (null: no value), or {"$regex": text}, which no missing value fits. Other operators are a ValueError.
    """
    fields = json.loads(document) if isinstance(document, str) else document or {}
    if not isinstance(fields, dict):
        raise ValueError(f"a filter is an object, not {fields!r}")
    whole = F.lit(True)
    for field, asked in fields.items():
        c = F.col(field)
        if isinstance(asked, dict):
            if set(asked) != {"$regex"} or not isinstance(asked["$regex"], str):
                raise ValueError(f"{field}: filters know values and $regex, not {sorted(asked)}")
            prefix, all_of_it = literal_prefix(asked["$regex"])
            fits = [c.startswith(prefix)] if prefix else []
            fits += [] if all_of_it and prefix else [c.rlike(asked["$regex"])]
            for f in fits:
                whole = whole & f
        else:
            whole = whole & (c.isNull() if asked is None else c == F.lit(asked))
    return whole
