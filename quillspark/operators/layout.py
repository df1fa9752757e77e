"""Lines and blocks of a quote's document: texts wrapped by glyph widths, row heights, and the terms and notes that follow the table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widths of the characters 32 to 126 in Helvetica, in thousandths of the font size. Fixed values.
WIDTHS = (
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
)
#: Width of all other characters.
OTHER = 556
#: Sizes of the document, in points: a row, a line, what a row's notes add, spaces before and after blocks. Fixed values.
ROW, LINE, NOTE_SPACE, BLOCK_SPACE, BLOCK_END, NEAR_BOTTOM = 24, 14, 6, 16, 8, 100


def _char_width(c: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, WIDTHS)), F.ascii(c) - 32), F.lit(OTHER))


def text_width(text: Column) -> Column:
    """Sum of the widths of a text's characters, in thousandths of the font size: a count for each width, no step for each character."""
    by_width: dict[int, str] = {}
    for k, w in enumerate(WIDTHS):
        if w != OTHER:
            by_width[w] = by_width.get(w, "") + chr(32 + k)
    total = F.length(text) * OTHER
    for w, chars in by_width.items():
        total = total + (F.length(text) - F.length(F.translate(text, chars, ""))) * (w - OTHER)
    return total.cast("double")


def _cut(word: Column, first: Column, limit: float) -> Column:
    """Pieces of a word that is wider than a line: the first fits what is left of one, the others whole lines."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(0.0).alias("w"))

    def step(acc: Column, c: Column) -> Column:
        w = _char_width(c).cast("double")
        opening = F.size(acc["out"]) == 0
        full = F.when(opening, acc["w"] + w >= first).otherwise(acc["w"] + w > limit)
        return F.when(full, F.struct(F.array_append(acc["out"], acc["cur"]).alias("out"), c.alias("cur"), w.alias("w"))).otherwise(F.struct(acc["out"].alias("out"), F.concat(acc["cur"], c).alias("cur"), (acc["w"] + w).alias("w")))

    return F.aggregate(chars, start, step, lambda acc: F.array_append(acc["out"], acc["cur"]))


def wrapped(text: Column, width: float, size: float = 12) -> Column:
    """Lines of a text within ``width`` points: as many words as fit; a wider word is cut. Null or empty has none; an empty paragraph is an empty line."""
    limit, space = width * 1000 / size, float(WIDTHS[0])
    kind = "array<string>"

    def paragraph(p: Column) -> Column:
        words = F.transform(F.split(p, " "), lambda w: F.struct(w.alias("t"), text_width(w).alias("w")))
        start = F.struct(F.array().cast(kind).alias("lines"), F.lit(None).cast("string").alias("cur"), F.lit(0.0).alias("w"))

        def state(lines: Column, cur: Column, w: Column) -> Column:
            return F.struct(lines.alias("lines"), cur.alias("cur"), w.alias("w"))

        def step(acc: Column, x: Column) -> Column:
            used = F.when(acc["cur"].isNull(), 0.0).otherwise(acc["w"] + space)
            joined = F.when(acc["cur"].isNull(), x["t"]).otherwise(F.concat(acc["cur"], F.lit(" "), x["t"]))

            def long(pieces: Column) -> Column:
                head = F.when(acc["cur"].isNull(), pieces[0]).otherwise(F.concat(acc["cur"], F.lit(" "), pieces[0]))
                inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
                last = F.element_at(pieces, -1)
                return state(F.concat(acc["lines"], F.array(head), inner), last, text_width(last))

            cut = F.element_at(F.transform(F.array(_cut(x["t"], F.lit(limit) - used, limit)), long), 1)
            next_line = F.when(x["w"] > limit, cut).otherwise(state(F.array_append(acc["lines"], acc["cur"]), x["t"], x["w"]))
            return F.when(used + x["w"] > limit, next_line).otherwise(state(acc["lines"], joined, used + x["w"]))

        return F.aggregate(words, start, step, lambda acc: F.array_append(acc["lines"], acc["cur"]))

    lines = F.flatten(F.transform(F.split(text, r"\r?\n"), paragraph))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast(kind)).otherwise(lines)


def row_height(note_lines: Column) -> Column:
    """Height of a line item with the wrapped lines of its notes under it."""
    n = F.size(note_lines)
    return (F.lit(ROW) + F.when(n > 0, n * LINE + NOTE_SPACE).otherwise(0)).cast("double")


def closing_blocks(page: Column, y: Column, terms: Column, notes: Column, margin: float, height: float) -> Column:
    """array of struct(kind, page, y, lines): terms and notes after a table that ends at ``y`` of ``page``; blocks without lines are left out.

    A block whose heading would stand within the last NEAR_BOTTOM points of a page starts the next one.
    """
    blocks = F.filter(F.array(F.struct(F.lit("TERMS").alias("kind"), terms.alias("lines")), F.struct(F.lit("NOTES").alias("kind"), notes.alias("lines"))), lambda b: F.size(b["lines"]) > 0)
    start = F.struct(page.cast("int").alias("page"), (y + BLOCK_SPACE).cast("double").alias("y"), F.array().cast("array<struct<kind:string,page:int,y:double,lines:array<string>>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        low = acc["y"] > height - NEAR_BOTTOM
        at, on = F.when(low, F.lit(float(margin))).otherwise(acc["y"]), acc["page"] + low.cast("int")
        made = F.struct(b["kind"].alias("kind"), on.alias("page"), at.alias("y"), b["lines"].alias("lines"))
        return F.struct(on.alias("page"), (at + LINE + F.size(b["lines"]) * LINE + BLOCK_END).cast("double").alias("y"), F.array_append(acc["out"], made).alias("out"))

    return F.aggregate(blocks, start, step, lambda acc: acc["out"])
