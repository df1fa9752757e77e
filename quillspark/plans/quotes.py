"""Queries of the quoting workflow on the driver's tables, each with its SQL.

The mapping is an analogy: quotes are orders, accounts are customers, contacts are nations' names, line items are line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import js, text
from quillspark.operators import breaks, layout
from quillspark.operators import quotes as Q
from quillspark.plans.registry import register
from quillspark.sources.snapshots import Store, work_folder
from quillspark.sources.tables import table, unwrapped

_TOP = "(select * from orders order by o_orderdate desc nulls last, o_orderkey limit 200)"


def _recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.listed(table(spark, sf_dir, "orders"), "-o_orderdate", 200, "o_orderkey")


@register("recent_orders_top200", f"select o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') as created from {_TOP}")
def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recent(spark, sf_dir).select("o_orderkey", "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@register("kpi_recent", f"select count(*) as n, count(*) filter (o_orderstatus = 'O') as new_count, count(*) filter (o_orderstatus = 'P') as in_review, count(*) filter (o_orderstatus = 'F') as sent, coalesce(round(sum(cast(coalesce(o_totalprice, 0) as decimal(38,6))), 2)::double, 0) as total_value from {_TOP}")
def kpi_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_figures(_recent(spark, sf_dir), "o_orderstatus", "o_totalprice", {"new_count": "O", "in_review": "P", "sent": "F"})


@register("status_counts_domain", "select d.status, d.position, coalesce(c.n, 0) as n from (values ('F', 0), ('O', 1), ('P', 2), ('X', 3)) d(status, position) left join (select o_orderstatus, count(*) as n from orders group by 1) c on c.o_orderstatus = d.status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", ("F", "O", "P", "X"))


@register("status_filtered_recent", f"select o_orderkey, case when o_orderpriority = '' then '-' else coalesce(o_orderpriority, '-') end as rep, coalesce(o_totalprice, 0) as total, coalesce(strftime(o_orderdate, '%b %-d, %Y'), '-') as shown from {_TOP} where o_orderstatus = 'O'")
def status_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q.with_status(_recent(spark, sf_dir), "o_orderstatus", "O")
    return rows.select("o_orderkey", F.coalesce(js.or_text(F.col("o_orderpriority"), F.lit("-")), F.lit("-")).alias("rep"), js.or_zero(F.col("o_totalprice")).alias("total"), F.coalesce(F.date_format("o_orderdate", "MMM d, yyyy"), F.lit("-")).alias("shown"))


@register("account_projection", "select c_custkey as id, c_name as name, c_mktsegment as industry, '' as billing_address from customer order by c_name nulls last, c_custkey limit 500")
def account_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.listed(table(spark, sf_dir, "customer"), "c_name", 500, "c_custkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("industry"), F.lit("").alias("billing_address"))


@register("contacts_by_account", "select n_nationkey as account_id, s_suppkey as contact_id, s_name as contact_name from nation left join supplier on s_nationkey = n_nationkey")
def contacts_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").select(F.col("n_nationkey").alias("account_id"), F.col("s_suppkey").alias("contact_id"), F.col("s_name").alias("contact_name"))


@register(
    "deal_resolution",
    """select o_orderkey as id, case when o_orderkey % 5 = 0 then 'deal ' || o_orderkey when o_orderkey % 5 = 1 then '' else o_orderpriority end as title,
      case when o_orderkey % 3 = 0 then o_totalprice else o_totalprice + 1 end as value,
      case when o_orderkey % 7 = 0 then '' else o_custkey::varchar end as account_id,
      case when o_orderkey % 4 = 0 then 'own' when o_orderkey % 7 = 0 then '' else coalesce(c_name, '') end as account_name,
      case when o_orderkey % 6 = 0 then '' else (o_custkey % 30)::varchar end as contact_id,
      case when o_orderkey % 6 <> 0 and n_nationkey is not null then case when n_nationkey % 2 = 0 then n_name || ' Rep' else n_name end else 'mine' end as contact_name,
      case when o_orderkey % 6 <> 0 and n_nationkey is not null then case when n_nationkey % 3 = 0 then '' else lower(n_name) || '@x.org' end else 'me@x.org' end as contact_email,
      case when o_orderkey % 2 = 0 then o_orderstatus else 'none' end as product
    from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = o_custkey % 30""",
)
def deal_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    k = F.col("o_orderkey")
    deals = o.select(
        k.alias("id"),
        F.when(k % 5 == 0, F.concat(F.lit("deal "), k.cast("string"))).otherwise("").alias("title"),
        F.when(k % 5 <= 1, "").otherwise(F.col("o_orderpriority")).alias("name"),
        F.when(k % 3 == 0, F.col("o_totalprice")).alias("value"),
        (F.col("o_totalprice") + 1).alias("amount"),
        F.when(k % 7 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("account_id"),
        F.when(k % 4 == 0, "own").alias("account_name"),
        F.when(k % 6 == 0, "").otherwise((F.col("o_custkey") % 30).cast("string")).alias("contact_id"),
        F.lit("mine").alias("contact_name"),
        F.lit("me@x.org").alias("contact_email"),
        F.when(k % 2 == 0, F.col("o_orderstatus")).alias("product"),
        F.lit("none").alias("product_name"),
    )
    accounts = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    contacts = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("first_name"), F.when(F.col("n_nationkey") % 2 == 0, "Rep").otherwise("").alias("last_name"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(F.lower("n_name"), F.lit("@x.org"))).alias("email"))
    return Q.resolve_deals(deals, accounts, contacts)


@register(
    "quote_totals",
    """select o_orderkey, count(l_orderkey) as lines, coalesce(sum(cast(l_quantity * l_extendedprice as decimal(38,6))), 0)::double as total
    from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
)
def quote_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = Q.line_totals(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", "l_extendedprice")
    df = table(spark, sf_dir, "orders").select("o_orderkey").join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.select("o_orderkey", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("total", F.lit(0.0)).alias("total"))


_PREFIX_SQL = "strftime(o_orderdate, '%m%d%Y') || '-XX-' || upper(substr(c_mktsegment, 1, 3))"


@register(
    "quote_numbering",
    f"""with q as (select o_orderkey, o_orderdate, {_PREFIX_SQL} as prefix from orders join customer on c_custkey = o_custkey),
      e as (select prefix, max(o_orderkey % 900) as last from q where o_orderkey % 10 = 0 group by 1)
    select o_orderkey, q.prefix || '-' || lpad((n + coalesce(last, 0))::varchar, greatest(3, length((n + coalesce(last, 0))::varchar))::int, '0') as quote_number
    from (select *, row_number() over (partition by prefix order by o_orderdate, o_orderkey) as n from q where o_orderkey % 10 <> 0) q left join e on e.prefix = q.prefix""",
)
def quote_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    q = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", F.concat_ws("-", text.date_code(F.col("o_orderdate")), text.initials(F.lit(None).cast("string")), text.customer_key(F.col("c_mktsegment"))).alias("prefix"))
    existing = q.filter("o_orderkey % 10 = 0").select("prefix", text.quote_number(F.col("prefix"), F.col("o_orderkey") % 900).alias("quote_number"))
    return Q.numbered(q.filter("o_orderkey % 10 <> 0"), "prefix", ("o_orderdate", "o_orderkey"), existing).select("o_orderkey", "quote_number")


@register("required_fields", "select c_custkey, (c_custkey % 5 <> 0 and length(trim(c_name)) > 0) as valid_customer, (c_custkey % 3 <> 0) as valid_note from customer")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumns({"email": F.when(F.col("c_custkey") % 5 != 0, "a@x.org").otherwise(""), "note": F.when(F.col("c_custkey") % 3 == 0, " \t ").otherwise(" n ")})
    some = lambda k: F.coalesce(F.col(k) != "", F.lit(False))
    return c.select("c_custkey", (some("c_name") & some("email")).alias("valid_customer"), js.not_blank(F.col("note")).alias("valid_note"))


@register(
    "latest_patch_state",
    """select user_id, arg_max(event_type, (ts, event_id)) filter (event_id % 2 = 0) as status, arg_max(value, (ts, event_id)) filter (event_id % 3 = 0) as total, count(*) as patches
    from events group by 1""",
)
def latest_patch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.latest_state(_patches(table(spark, sf_dir, "events")), "user_id", ("ts", "event_id"), _PATCH_FIELDS)


_PATCH_FIELDS = ("status", "total")


def _patches(events: DataFrame) -> DataFrame:
    fields = F.filter(F.array(F.when(F.col("event_id") % 2 == 0, "status"), F.when(F.col("event_id") % 3 == 0, "total")), lambda x: x.isNotNull())
    return events.select("user_id", "ts", "event_id", F.col("event_type").alias("status"), F.col("value").alias("total"), fields.alias("patched"))


@register(
    "patch_snapshot_state",
    """select user_id, arg_max(event_type, (ts, event_id)) filter (event_id % 2 = 0) as status, arg_max(value, (ts, event_id)) filter (event_id % 3 = 0) as total, count(*) as patches
    from events group by 1""",
)
def patch_snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after three batches, each merged into the stored snapshot; the second is sent twice, and patches of the last are older than stored ones."""
    events = _patches(table(spark, sf_dir, "events"))
    store = Store(spark, work_folder(spark), "user_id", ("ts", "event_id"), _PATCH_FIELDS, buckets=8)
    for batch, part in enumerate((0, 1, 1, 2)):
        store.apply(events.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part), batch if batch < 2 else batch - 1)
    return store.state()


@register("thread_lines_joined", "select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, text) as lines, count(*) as turns from conversations group by 1")
def thread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspark.operators.acquisition import joined_text

    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(joined_text("turn", "text", "\n").alias("lines"), F.count("*").alias("turns"))


@register("bounded_newest_queue", "select user_id, event_id, place from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as place from events) where place <= 20")
def newest_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("event_id")], 20).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@register(
    "line_item_array_edits",
    """with a as (select o_orderkey, list({'q': l_quantity, 'p': l_extendedprice} order by l_linenumber, l_quantity, l_extendedprice) as items from orders join lineitem on l_orderkey = o_orderkey group by 1)
    select o_orderkey, len(items) as n, round(items[1].q + 1, 2) as edited_first, len(items) + 1 as appended, len(items) - 1 as left_over, (case when len(items) > 1 then items[2].p end) as next_price from a""",
)
def array_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    nested = Q.nested_lines(o.join(li, o.o_orderkey == li.l_orderkey).select("o_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p")), "o_orderkey", "line", "q", "p")
    items = F.col("line_items")
    edited = Q.replaced(items, F.lit(0), q=items[0]["q"] + 1)
    added = F.array_append(items, F.struct(F.lit(0).cast("int").alias("line"), F.lit(1.0).alias("q"), F.lit(0.0).alias("p")))
    rest = Q.removed(items, F.lit(0))
    size = lambda c: F.size(c).cast("long")
    return nested.select("o_orderkey", size(items).alias("n"), F.round(edited[0]["q"], 2).alias("edited_first"), size(added).alias("appended"), size(rest).alias("left_over"), F.get(rest, F.lit(0))["p"].alias("next_price"))


@register(
    "nested_totals",
    "select l_orderkey, count(*) as lines, sum(cast(l_quantity * l_extendedprice as decimal(38,6)))::double as total from lineitem where l_orderkey % 10 = 0 group by 1",
)
def nested_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of quotes that are stored with their lines as an array."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 10 = 0").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    nested = Q.nested_lines(lines, "l_orderkey", "line", "quantity", "price")
    return nested.select("l_orderkey", F.size("line_items").cast("long").alias("lines"), Q.lines_total(F.col("line_items")).alias("total"))


@register(
    "page_break_fold",
    """with recursive h as (select l_orderkey, list({'n': l_linenumber, 'p': l_partkey, 'h': 24.0::double + case when l_quantity > 25 then floor(l_quantity / 10) * 14 + 6 else 0 end} order by l_linenumber, l_partkey, l_quantity) as items from lineitem group by 1),
      f as (select l_orderkey, items, 0 as pos, 1 as page, 40.0::double as y, 40.0::double as top from h
        union all select l_orderkey, items, pos + 1, case when y + items[pos + 1].h > 280 then page + 1 else page end, case when y + items[pos + 1].h > 280 then 40 else y end + items[pos + 1].h, case when y + items[pos + 1].h > 280 then 40 else y end from f where pos < len(items))
    select l_orderkey, pos - 1 as row, page, top as y, (pos - 1) % 2 = 0 as striped from f where pos > 0""",
)
def page_break_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("h", 24.0 + F.when(F.col("l_quantity") > 25, F.floor(F.col("l_quantity") / 10) * 14 + 6).otherwise(0))
    rows = Q.nested_lines(li.select("l_orderkey", "l_linenumber", "l_partkey", "h"), "l_orderkey", "l_linenumber", "l_partkey", "h").withColumn("at", Q.page_breaks(F.transform("line_items", lambda x: x["h"]), 40.0, 280.0))
    return rows.select("l_orderkey", F.posexplode("at").alias("row", "at")).select("l_orderkey", "row", F.col("at.page").alias("page"), F.col("at.y").alias("y"), (F.col("row") % 2 == 0).alias("striped"))


@register(
    "page_breaks_long",
    """with recursive r as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_quantity, 24.0::double + case when l_quantity > 25 then floor(l_quantity / 10) * 14 + 6 else 0 end as h from lineitem),
      n as (select l_suppkey, list({'k': l_orderkey, 'n': l_linenumber, 'p': l_partkey, 'q': l_quantity, 'h': h} order by l_orderkey, l_linenumber, l_partkey, l_quantity) as items from r group by 1),
      f as (select l_suppkey, items, 0 as pos, 1 as page, 40.0::double as y, 40.0::double as top from n
        union all select l_suppkey, items, pos + 1, case when y + items[pos + 1].h > 700 then page + 1 else page end, case when y + items[pos + 1].h > 700 then 40 else y end + items[pos + 1].h, case when y + items[pos + 1].h > 700 then 40 else y end from f where pos < len(items))
    select l_suppkey, items[pos].k as l_orderkey, items[pos].n as l_linenumber, items[pos].p as l_partkey, items[pos].q as l_quantity, page, top from f where pos > 0""",
)
def page_breaks_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one long document a supplier, whose rows are dealt into blocks of 2,048 order numbers."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", (24.0 + F.when(F.col("l_quantity") > 25, F.floor(F.col("l_quantity") / 10) * 14 + 6).otherwise(0)).alias("h"))
    return breaks.placed(li, "l_suppkey", F.floor(F.col("l_orderkey") / 2048), ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"], "h", 40.0, 700.0).drop("h")


@register(
    "deal_note_prefill",
    """select o_orderkey, case when o_orderkey % 4 = 0 then 'own note' when o_orderkey % 4 = 1 then 'Product: ' || o_orderstatus || chr(10) || 'Value: $' || (o_orderkey % 1000)::varchar || '.50'
      when o_orderkey % 4 = 2 then 'Product: ' || o_orderstatus || chr(10) || 'Value: $0.00' else '' end as note from orders""",
)
def deal_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(k % 4 >= 2, 0.0).otherwise((k % 1000) + 0.5)
    return table(spark, sf_dir, "orders").select("o_orderkey", text.deal_note(F.when(k % 4 == 0, "own note"), F.when(k % 4 != 3, F.col("o_orderstatus")), value).alias("note"))


@register("contact_full_name", "select s_suppkey, case when s_suppkey % 3 = 0 then s_name when s_suppkey % 3 = 1 then 'Ann ' || s_name else '' end as full_name from supplier")
def contact_full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.full_name(F.when(k % 3 == 1, "Ann").when(k % 3 == 2, ""), F.when(k % 3 != 2, F.col("s_name"))).alias("full_name"))


@register(
    "initials_and_key",
    """select p_partkey, upper(left(p_name, 1)) || case when length(p_name) - length(replace(p_name, ' ', '')) > 0 then upper(left(regexp_extract(p_name, '([^ ]+)$', 1), 1)) else '' end as initials,
      left(regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') || 'CUS', 3) as customer_key from part""",
)
def initials_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.initials(F.col("p_name")).alias("initials"), text.customer_key(F.col("p_brand")).alias("customer_key"))


@register("fmt_money_fixed2", "select o_orderkey, printf('%.2f', o_totalprice) as money, printf('%.2f', (o_orderkey % 1000) / 8.0 + case when o_orderkey % 2 = 1 then 0.001 else 0 end) as eighths from orders")
def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("o_orderkey") % 1000) / 8.0 + F.when(F.col("o_orderkey") % 2 == 1, 0.001).otherwise(0.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", js.fixed2(F.col("o_totalprice")).alias("money"), js.fixed2(x).alias("eighths"))


@register("json_envelope", "select event_id, user_id % 3 as kind, case when user_id % 4 = 3 then 0 else 1 end as items, case when user_id % 4 = 3 then null else cast(json_extract(props, '$.k') as bigint) end as k from events")
def json_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    props, u = F.col("props"), F.col("user_id")
    raw = F.when(u % 4 == 0, F.concat(F.lit("["), props, F.lit("]"))).when(u % 4 == 1, F.concat(F.lit('{"items":['), props, F.lit("]}"))).when(u % 4 == 2, F.concat(F.lit('{"data":['), props, F.lit("]}"))).otherwise("{}")
    items = unwrapped(raw, "struct<k:bigint>")
    return table(spark, sf_dir, "events").select("event_id", (u % 3).alias("kind"), F.size(items).alias("items"), F.get(items, F.lit(0))["k"].alias("k"))


_CELLS = "'<tr><td>' || {} || '</td><td>' || {} || '</td><td>$' || printf('%.2f', {}) || '</td><td>$' || printf('%.2f', {}) || '</td></tr>'"


@register(
    "quote_email_html",
    f"""with l as (select l_orderkey, string_agg({_CELLS.format("'P&lt;' || l_partkey", "l_quantity::int", "l_extendedprice", "l_quantity * l_extendedprice")}, '' order by l_linenumber, l_partkey::varchar, l_quantity, l_extendedprice) as rows from lineitem group by 1)
    select o_orderkey, '<html><body><h1>Quote ' || o_orderkey || '</h1><p>' || case o_orderkey % 4 when 0 then '' else 'sheet metal ' || o_orderkey % 4 end || '</p><p>Dear ' || replace(replace(coalesce(c_name, ''), '&', '&amp;'), '<', '&lt;')
      || ',</p><p>Thank you for your inquiry regarding <strong>A &amp; B ' || o_orderpriority || '</strong>. Please find our quote details below:</p><table><thead><tr><th>Description</th><th>Qty</th><th>Unit Price</th><th>Total</th></tr></thead><tbody>' || coalesce(rows, '')
      || case when o_orderkey % 3 > 0 then {_CELLS.format("'Labor (' || o_orderkey % 3 || '.5 hrs @ $50/hr)'", "'1'", "(o_orderkey % 3 + 0.5) * 50", "(o_orderkey % 3 + 0.5) * 50")} else '' end
      || '</tbody></table><p>Total: $' || printf('%.2f', o_totalprice) || '</p><p><strong>Lead Time:</strong> ' || case when o_orderkey % 5 = 0 then 'TBD ' else o_orderkey % 5 || ' days' end || '</p>'
      || case when o_orderkey % 2 = 0 then '<p><strong>Notes:</strong></p><p>&quot;' || o_orderstatus || '&quot; &gt; 1' || chr(10) || 'x</p>' else '' end
      || '<p>Please contact us to proceed with this quote or if you have any questions.</p><p>Best regards,<br/>Manufacturing Team</p></body></html>' as html
    from orders left join l on l_orderkey = o_orderkey left join customer on c_custkey = o_custkey""",
)
def quote_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.concat(F.lit("P<"), F.col("l_partkey").cast("string")).alias("description"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    nested = Q.nested_lines(li, "l_orderkey", "line", "description", "quantity", "price")
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    df = orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(customers, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("o_orderkey")
    quote = {
        "number": k.cast("string"), "project_type": F.when(k % 4 != 0, F.concat(F.lit("sheet_metal_"), (k % 4).cast("string"))), "project_name": F.concat(F.lit("A & B "), F.col("o_orderpriority")), "customer": F.col("c_name"), "items": F.col("line_items"),
        "hours": F.when(k % 3 != 0, k % 3 + 0.5), "rate": F.lit(50.0), "total": F.col("o_totalprice"), "lead_days": F.when(k % 5 != 0, k % 5), "notes": F.when(k % 2 == 0, F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('" > 1\nx'))),
    }
    return df.select("o_orderkey", Q.email_html(quote).alias("html"))


#: Width of each character of a word, and lines of a text as words that fit; no word of the table is as wide as a line.
_WIDTH_SQL = f"list_sum(list_transform(string_split(x, ''), lambda c: case when c = '' then 0 else coalesce([{', '.join(map(str, layout.WIDTHS))}][ord(c) - 31], 556) end))"


def _lines_sql(text: str, width: int) -> str:
    words = f"list_transform(string_split(p, ' '), lambda x: {{'lines': []::varchar[], 'cur': x, 'w': coalesce({_WIDTH_SQL}, 0)::double}})"
    step = f"case when a.w + 278 + b.w > {width} * 1000 / 12.0::double then {{'lines': a.lines || [a.cur], 'cur': b.cur, 'w': b.w}} else {{'lines': a.lines, 'cur': a.cur || ' ' || b.cur, 'w': a.w + 278 + b.w}} end"
    return f"case when {text} = '' then [] else flatten(list_transform(list_transform(string_split_regex({text}, '\\r?\\n'), lambda p: list_reduce({words}, lambda a, b: {step})), lambda q: q.lines || [q.cur])) end"


@register(
    "quote_document_rows",
    # a conversation's turns as the notes of line items: lines, height, page and place of each row
    f"""with recursive n as (select conv_id, turn, {_lines_sql("text", 500)} as lines from conversations),
      h as (select conv_id, list({{'turn': turn, 'n': len(lines), 'first': lines[1], 'last': lines[-1], 'h': 24.0::double + case when len(lines) > 0 then len(lines) * 14 + 6 else 0 end}} order by turn) as items from n group by 1),
      f as (select conv_id, items, 0 as pos, 1 as page, 48.0::double as y, 48.0::double as top from h
        union all select conv_id, items, pos + 1, case when y + items[pos + 1].h > 672 then page + 1 else page end, case when y + items[pos + 1].h > 672 then 48 else y end + items[pos + 1].h, case when y + items[pos + 1].h > 672 then 48 else y end from f where pos < len(items))
    select conv_id, items[pos].turn as turn, items[pos].n as lines, items[pos].first as first_line, items[pos].last as last_line, items[pos].h as height, page, top as y from f where pos > 0""",
)
def quote_document_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = layout.wrapped(F.col("text"), 500)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.alias("l")).select("conv_id", "turn", F.size("l").cast("long").alias("lines"), F.get("l", F.lit(0)).alias("first_line"), F.element_at("l", -1).alias("last_line"), layout.row_height(F.col("l")).alias("height"))
    nested = Q.nested_lines(rows, "conv_id", "turn", "lines", "first_line", "last_line", "height")
    placed = nested.withColumn("at", Q.page_breaks(F.transform("line_items", lambda x: x["height"]), 48.0, 672.0))
    return placed.select("conv_id", F.explode(F.arrays_zip("line_items", "at")).alias("r")).select("conv_id", "r.line_items.*", "r.at.page", "r.at.y")


@register(
    "quote_closing_blocks",
    f"""with t as (select o_orderkey, case when o_orderkey % 3 = 0 then '' else repeat(o_orderpriority || ' due, ', (o_orderkey % 11 + 1)::int) || chr(10) || 'net 30' end as terms, case when o_orderkey % 4 = 0 then '' else repeat(o_orderstatus || ' note ', (o_orderkey % 17)::int) || 'end' end as notes, (o_orderkey % 60 * 12)::double as y from orders),
      w as (select *, {_lines_sql("terms", 200)} as tl, {_lines_sql("notes", 200)} as nl from t),
      a as (select *, case when len(tl) > 0 and y + 16 > 692 then 2 else 1 end as tp, case when len(tl) > 0 and y + 16 > 692 then 48 else y + 16 end as ty from w),
      b as (select *, case when len(tl) > 0 then ty + 14 + len(tl) * 14 + 8 else y + 16 end as after from a),
      c as (select o_orderkey, 'TERMS' as kind, tp as page, ty as y, tl as lines from b where len(tl) > 0 union all select o_orderkey, 'NOTES', case when after > 692 then tp + 1 else tp end, case when after > 692 then 48 else after end, nl from b where len(nl) > 0)
    select o_orderkey, kind, page, y, array_to_string(lines, '|') as lines from c""",
)
def quote_closing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    terms = F.when(k % 3 == 0, "").otherwise(F.concat(F.repeat(F.concat("o_orderpriority", F.lit(" due, ")), (k % 11 + 1).cast("int")), F.lit("\nnet 30")))
    notes = F.when(k % 4 == 0, "").otherwise(F.concat(F.repeat(F.concat("o_orderstatus", F.lit(" note ")), (k % 17).cast("int")), F.lit("end")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", layout.wrapped(terms, 200).alias("t"), layout.wrapped(notes, 200).alias("n"))
    blocks = layout.closing_blocks(F.lit(1), (k % 60 * 12).cast("double"), F.col("t"), F.col("n"), 48, 792)
    return rows.select("o_orderkey", F.explode(blocks).alias("b")).select("o_orderkey", "b.kind", "b.page", "b.y", F.array_join("b.lines", "|").alias("lines"))


@register("column_offsets", "select l_orderkey, l_linenumber, l_partkey, l_quantity, coalesce(sum(l_quantity) over w, 0) as left_offset from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate rows between unbounded preceding and 1 preceding)")
def column_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.coalesce(F.sum("l_quantity").over(w), F.lit(0.0)).alias("left_offset"))
