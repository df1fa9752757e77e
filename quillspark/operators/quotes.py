"""Relational operators of the quoting workflow: listings, key figures, lookups, pricing, numbering, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import js, text


def listed(df: DataFrame, sort: str, limit: int, tie: str) -> DataFrame:
    """The first ``limit`` rows by ``sort`` ('-' in front: descending), nulls last; ``tie`` makes the order whole."""
    key = F.desc_nulls_last(sort[1:]) if sort.startswith("-") else F.asc_nulls_last(sort)
    return df.orderBy(key, F.asc(tie)).limit(limit)


def key_figures(quotes: DataFrame, status: str, total: str, counted: dict[str, str]) -> DataFrame:
    """One row: n, a count for each name in ``counted`` (name -> status) and total_value; empty input gives zeros."""
    counts = [F.count_if(F.col(status) == s).alias(n) for n, s in counted.items()]
    return quotes.agg(F.count("*").alias("n"), *counts, F.coalesce(F.round(F.sum(js.or_zero(F.col(total)).cast("decimal(38,6)")), 2).cast("double"), F.lit(0.0)).alias("total_value"))


def status_counts(quotes: DataFrame, status: str, domain: tuple[str, ...]) -> DataFrame:
    """A row for each status of ``domain``, also those without quotes."""
    spark = quotes.sparkSession
    names = spark.createDataFrame([(s, k) for k, s in enumerate(domain)], "status string, position int")
    found = quotes.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return names.join(found, "status", "left").select("status", "position", F.coalesce("n", F.lit(0)).alias("n"))


def with_status(quotes: DataFrame, status: str, wanted: str) -> DataFrame:
    return quotes if wanted == "all" else quotes.filter(F.col(status) == wanted)


def resolve_deals(deals: DataFrame, accounts: DataFrame, contacts: DataFrame) -> DataFrame:
    """Deals with account and contact names.

    The account's name is looked up only where the deal has none; a contact that is found replaces the deal's name and e-mail even by blanks.
    deals: id, title, name, value, amount, account_id, account_name, contact_id, contact_name, contact_email, product, product_name; accounts: id, name;
    contacts: id, first_name, last_name, email. Neither lookup table may repeat an id.
    """
    a = accounts.select(F.col("id").alias("account_id"), F.col("name").alias("_account"))
    c = contacts.select(F.col("id").alias("contact_id"), js.trim(text.full_name(F.col("first_name"), F.col("last_name"))).alias("_name"), F.coalesce("email", F.lit("")).alias("_email"), F.lit(True).alias("_found"))
    df = deals.join(a, "account_id", "left").join(c, "contact_id", "left")
    own = F.coalesce("account_name", F.lit(""))
    pick = lambda found, mine: F.when(F.col("_found"), F.col(found)).otherwise(F.coalesce(mine, F.lit("")))
    empty = F.lit("")
    return df.select(
        "id",
        js.or_text(F.col("title"), F.col("name"), empty).alias("title"),
        F.coalesce("value", "amount").alias("value"),
        F.coalesce("account_id", empty).alias("account_id"),
        F.when((own == "") & (F.coalesce("account_id", empty) != ""), F.coalesce("_account", empty)).otherwise(own).alias("account_name"),
        F.coalesce("contact_id", empty).alias("contact_id"),
        pick("_name", "contact_name").alias("contact_name"),
        pick("_email", "contact_email").alias("contact_email"),
        js.or_text(F.col("product"), F.col("product_name"), empty).alias("product"),
    )


def nested_lines(lines: DataFrame, key: str, *fields: str) -> DataFrame:
    """key and line_items: the lines of each key as one array, in order of all their fields."""
    return lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("line_items"))


def lines_total(items: Column, quantity: str = "quantity", price: str = "price") -> Column:
    """Sum of quantity * price; missing values count as 0, and so does a missing array."""
    one = lambda i: (js.or_zero(i[quantity]) * js.or_zero(i[price])).cast("decimal(38,6)")
    total = F.aggregate(items, F.lit(0).cast("decimal(38,6)"), lambda acc, i: (acc + one(i)).cast("decimal(38,6)"))
    return F.coalesce(total.cast("double"), F.lit(0.0))


def line_totals(lines: DataFrame, key: str, quantity: str, price: str) -> DataFrame:
    """key, lines, total: the sum of quantity * price of each key's lines, summed up before they are shuffled."""
    one = (js.or_zero(F.col(quantity)) * js.or_zero(F.col(price))).cast("decimal(38,6)")
    return lines.groupBy(key).agg(F.count("*").alias("lines"), F.sum(one).cast("double").alias("total"))


def numbered(quotes: DataFrame, prefix: str, order: tuple[str, ...], existing: DataFrame) -> DataFrame:
    """Add quote_number: the next number of each prefix, by ``order``, after the largest among ``existing`` (prefix, quote_number)."""
    last = existing.groupBy(prefix).agg(F.max(text.sequence_of(F.col("quote_number"))).alias("_last"))
    n = F.row_number().over(Window.partitionBy(prefix).orderBy(*order))
    out = quotes.join(last, prefix, "left").withColumn("_n", n + F.coalesce("_last", F.lit(0)))
    return out.withColumn("quote_number", text.quote_number(F.col(prefix), F.col("_n"))).drop("_last", "_n")


def latest_state(patches: DataFrame, key: str, order: tuple[str, ...], fields: tuple[str, ...], present: str = "patched") -> DataFrame:
    """The state of each key after all its patches: of each field the value of the last patch that holds it.

    ``present`` is an array of the field names a patch holds, so that a patch can set a field to null.
    """
    at = F.struct(*order)
    last = lambda f: F.max_by(F.struct(F.col(f)), F.when(F.array_contains(present, f), at))[f].alias(f)
    return patches.groupBy(key).agg(*[last(f) for f in fields], F.count("*").alias("patches"))


def newest(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The newest ``limit`` rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= limit)


def replaced(items: Column, index: Column, **values: Column) -> Column:
    """Fields of the item at ``index`` (from 0) replaced."""

    def one(x: Column, i: Column) -> Column:
        y = x
        for k, v in values.items():
            y = y.withField(k, v)
        return F.when(i == index, y).otherwise(x)

    return F.transform(items, one)


def removed(items: Column, index: Column) -> Column:
    return F.filter(items, lambda x, i: i != index)


def page_breaks(rows: Column, margin: float, bottom: float, page: Column | None = None, y: Column | None = None) -> Column:
    """Top of each row: heights add up, and a row that would pass ``bottom`` starts a page at ``margin``. rows: array of heights.

    The first row follows ``y`` of ``page``, by default the top of the first. ``breaks.placed`` does the same for documents of any length.
    """

    def step(acc: Column, h: Column) -> Column:
        new = acc["y"] + h > bottom
        y, page = F.when(new, margin).otherwise(acc["y"]), acc["page"] + new.cast("int")
        return F.struct((y + h).alias("y"), page.alias("page"), F.array_append(acc["out"], F.struct(page.alias("page"), y.alias("y"))).alias("out"))

    at, first = F.lit(margin) if y is None else y, F.lit(1) if page is None else page
    start = F.struct(at.cast("double").alias("y"), first.cast("int").alias("page"), F.array().cast("array<struct<page:int,y:double>>").alias("out"))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def email_html(quote: dict[str, Column]) -> Column:
    """Body of a quote's e-mail from its fields (number, project_type, project_name, customer, items, hours, rate, total, lead_days, notes): heading with the
    project's type, greeting, priced lines, labour as a line if it costs something, total, lead time, notes if there are any, and a closing.

    items is an array of struct(description, quantity, price). Texts are escaped; missing numbers count as 0, missing items as none.
    """
    money = lambda x: F.concat(F.lit("$"), js.fixed2(js.or_zero(x)))
    cells = lambda *cs: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cs], F.lit("</tr>"))
    row = lambda i: cells(text.escaped(i["description"]), js.number_text(js.or_zero(i["quantity"])), money(i["price"]), money(js.or_zero(i["quantity"]) * js.or_zero(i["price"])))
    hours, rate, days = js.or_zero(quote["hours"]), js.or_zero(quote["rate"]), js.or_zero(quote["lead_days"])
    labour = hours * rate
    label = F.concat(F.lit("Labor ("), js.number_text(hours), F.lit(" hrs @ $"), js.number_text(rate), F.lit("/hr)"))
    notes = F.coalesce(quote["notes"], F.lit(""))
    return F.concat(
        F.lit("<html><body><h1>Quote "), text.escaped(quote["number"]), F.lit("</h1><p>"), text.escaped(text.spaced(quote["project_type"])), F.lit("</p><p>Dear "), text.escaped(quote["customer"]),
        F.lit(",</p><p>Thank you for your inquiry regarding <strong>"), text.escaped(quote["project_name"]), F.lit("</strong>. Please find our quote details below:</p>"),
        F.lit("<table><thead><tr><th>Description</th><th>Qty</th><th>Unit Price</th><th>Total</th></tr></thead><tbody>"),
        F.coalesce(F.array_join(F.transform(quote["items"], row), ""), F.lit("")), F.when(labour > 0, cells(label, F.lit("1"), money(labour), money(labour))).otherwise(""),
        F.lit("</tbody></table><p>Total: "), money(quote["total"]), F.lit("</p><p><strong>Lead Time:</strong> "), F.when(days != 0, F.concat(js.number_text(days), F.lit(" days"))).otherwise("TBD "), F.lit("</p>"),
        F.when(notes != "", F.concat(F.lit("<p><strong>Notes:</strong></p><p>"), text.escaped(notes), F.lit("</p>"))).otherwise(""),
        F.lit("<p>Please contact us to proceed with this quote or if you have any questions.</p><p>Best regards,<br/>Manufacturing Team</p></body></html>"),
    )


def point_read(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))


def prefix_scan(df: DataFrame, field: str, prefix: str) -> DataFrame:
    """Rows whose ``field`` begins with ``prefix``; the filter reaches the scan."""
    return df.filter(F.col(field).startswith(prefix))


def by_optional_key(df: DataFrame, key: str, value: object | None) -> DataFrame:
    """Rows of one key, or all without one."""
    return df if value in (None, "") else df.filter(F.col(key) == F.lit(value))


def created(existing: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Existing rows and new ones, whose missing or null fields take their defaults and else null."""
    given = new.withColumns({k: F.coalesce(F.col(k), v) if k in new.columns else v for k, v in defaults.items()})
    return existing.unionByName(given, allowMissingColumns=True).select(*existing.columns)


def append(new: DataFrame, path: str) -> None:
    """Append rows to a stored table."""
    new.write.mode("append").parquet(path)


def first_by(items: Column, field: str, value: Column) -> Column:
    """The first item whose ``field`` is ``value``; null if there is none."""
    return F.get(F.filter(items, lambda x: x[field] == value), F.lit(0))


def picked(items: Column) -> Column:
    """The item shown at first: the first, null of none."""
    return F.get(items, F.lit(0))


def repicked(items: Column, selected: Column, field: str) -> Column:
    """What is shown after a removal: ``selected`` while it is among ``items``, else the first. Nothing stays nothing."""
    here = first_by(items, field, selected[field])
    return F.when(selected.isNull(), selected).when(here.isNull(), picked(items)).otherwise(selected)


def priced_line(quantity: Column, price: Column) -> Column:
    """struct(quantity, price, line_total) as a quote's table shows them: what is 0 is blank. Texts that are no number count as 0."""
    q, p = js.or_zero(quantity.try_cast("double")), js.or_zero(price.try_cast("double"))
    money = lambda x: F.when(x == 0, "").otherwise(F.concat(F.lit("$"), js.fixed2(x)))
    return F.struct(F.when(q == 0, "").otherwise(js.number_text(q)).alias("quantity"), money(p).alias("price"), money(q * p).alias("line_total"))
