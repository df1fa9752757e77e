"""Queries that read, create and pick single records, and what is shown of them, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import js, text
from quillspark.operators import quotes as Q
from quillspark.plans.registry import register
from quillspark.sources.tables import table

_HOSTS = {"m.example.com": "/media/", "static.example.com": "/"}


@register("quote_point_read", "select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 7")
def quote_point_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.point_read(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_orderstatus", "o_totalprice")


@register("part_prefix_scan", "select p_partkey, p_brand from part where starts_with(p_brand, 'Brand#1')")
def part_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.prefix_scan(table(spark, sf_dir, "part"), "p_brand", "Brand#1").select("p_partkey", "p_brand")


@register("created_quotes", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders union all select 10000000 + c_custkey, c_custkey, case when c_custkey % 2 = 0 then 'quoted' else 'new' end, 0 from customer")
def created_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    k = F.col("c_custkey")
    new = table(spark, sf_dir, "customer").select((k + 10_000_000).alias("o_orderkey"), k.alias("o_custkey"), F.when(k % 2 == 0, "quoted").alias("o_orderstatus"))
    return Q.created(orders, new, {"o_orderstatus": F.lit("new"), "o_totalprice": F.lit(0.0)})


@register(
    "contact_projection",
    """with c as (select s_suppkey as id, 'Rep' as first_name, s_name as last_name, lower(s_name) || '@x.org' as email, (s_nationkey + 10)::varchar as phone, s_nationkey from supplier)
    select 'one' as asked, id, first_name, last_name, email, phone from (select * from c where s_nationkey = 3 order by last_name, id limit 500) union all select 'all', id, first_name, last_name, email, phone from (select * from c order by last_name, id limit 500)""",
)
def contact_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("Rep").alias("first_name"), F.col("s_name").alias("last_name"), F.concat(F.lower("s_name"), F.lit("@x.org")).alias("email"), (F.col("s_nationkey") + 10).cast("string").alias("phone"), "s_nationkey")
    asked = lambda name, key: Q.listed(Q.by_optional_key(s, "s_nationkey", key), "last_name", 500, "id").select(F.lit(name).alias("asked"), "id", "first_name", "last_name", "email", "phone")
    return asked("one", 3).unionByName(asked("all", None))


@register(
    "document_picks",
    """with d as (select l_orderkey, list({'name': l_linenumber, 'part': l_partkey} order by l_linenumber, l_partkey) as docs from lineitem group by 1), r as (select *, list_filter(docs, lambda x, i: i <> 1) as rest from d)
    select l_orderkey, docs[1].part as shown, (list_filter(docs, lambda x: x.name = 3))[1].part as third, (case when len(list_filter(rest, lambda x: x.name = docs[1].name)) > 0 then docs[1] else rest[1] end).part as after_removal,
      (case when len(docs) > 1 then case when len(list_filter(rest, lambda x: x.name = docs[2].name)) > 0 then docs[2] else rest[1] end end).part as other_kept from r""",
)
def document_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("name"), F.col("l_partkey").alias("part"))
    docs = F.col("line_items")
    rest = Q.removed(docs, F.lit(0))
    second = F.get(docs, F.lit(1))
    return Q.nested_lines(lines, "l_orderkey", "name", "part").select("l_orderkey", Q.picked(docs)["part"].alias("shown"), Q.first_by(docs, "name", F.lit(3))["part"].alias("third"), Q.repicked(rest, Q.picked(docs), "name")["part"].alias("after_removal"), Q.repicked(rest, second, "name")["part"].alias("other_kept"))


@register(
    "priced_lines",
    """with l as (select *, case when l_partkey % 5 = 0 then 0 else l_quantity end as q, case when l_partkey % 7 = 0 then 0 else l_extendedprice end as p from lineitem)
    select l_orderkey, l_linenumber, l_partkey, case when q = 0 then '' else q::int::varchar end as quantity, case when p = 0 then '' else '$' || printf('%.2f', p) end as price, case when q * p = 0 then '' else '$' || printf('%.2f', q * p) end as line_total from l""",
)
def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    line = Q.priced_line(F.when(k % 10 == 0, "none").when(k % 5 != 0, F.col("l_quantity").cast("string")), F.when(k % 7 != 0, F.col("l_extendedprice")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", k, line.alias("x")).select("l_orderkey", "l_linenumber", "l_partkey", "x.*")


@register("review_note_moments", "select event_id, case when event_id % 9 = 0 then '' else strftime(ts, '%b %-d, %Y %-I:%M %p') end as shown from events")
def review_note_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.moment(F.when(F.col("event_id") % 9 != 0, F.col("ts"))).alias("shown"))


_LABELS = dict(zip(text.STATUSES, ("New", "In Review", "Quoted", "Sent", "Accepted", "Rejected"), strict=True))


@register("status_labels", "select o_orderkey, case o_orderkey % 8 " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(_LABELS.values())) + " else 'New' end as label from orders")
def status_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in (*text.STATUSES, "lost", None)]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.status_label(status).alias("label"))


@register("header_lines", "select c_custkey, concat_ws(' | ', nullif(c_name, ''), case when c_custkey % 2 = 0 then c_mktsegment end, case when c_custkey % 3 = 0 then 'a@x.org' end) as header, case when c_custkey % 6 = 0 then 3 when c_custkey % 2 = 0 or c_custkey % 3 = 0 then 2 else 1 end as lines from customer")
def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lines = text.compacted(F.col("c_name"), F.when(k % 2 == 0, F.col("c_mktsegment")), F.when(k % 3 == 0, "a@x.org").otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(lines, " | ").alias("header"), F.size(lines).alias("lines"))


@register(
    "config_labels",
    """with l as (select o_orderkey, case o_orderkey % 3 when 0 then o_orderstatus when 1 then o_orderpriority else 'kind' end as label from orders)
    select o_orderkey, case label when 'F' then 'Filled' when 'O' then 'Open' when '1-URGENT' then 'Urgent' else 'Any' end as shown from l""",
)
def config_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    config = F.create_map(*[F.lit(x) for pair in (("F", "Filled"), ("O", "Open"), ("1-URGENT", "Urgent"), ("kind", "Any")) for x in pair])
    payload, nested = F.when(k % 3 == 0, F.create_map(F.lit("kind"), "o_orderstatus")), F.when(k % 3 < 2, F.create_map(F.lit("kind"), "o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.config_value(config, payload, nested, "kind").alias("shown"))


@register(
    "filter_urls",
    """with f as (select p_partkey, case when p_partkey % 4 = 0 then '{}' else '{"account_id":"' || p_name || ' (a*b)!~''é' || '"}' end as f from part)
    select p_partkey, 'https://api.example.com/Contact?limit=500&q=' || replace(replace(replace(replace(replace(url_encode(f), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*') as url from f""",
)
def filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.col("p_name"), F.lit(" (a*b)!~'é")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://api.example.com/Contact?limit=500&q="), text.filter_query("account_id", value)).alias("url"))


@register("fit_scales", "select p_partkey, least(case when p_partkey % 3 = 0 then p_size * 40 when p_partkey % 3 = 1 then p_size * 7 else 600 end, 800) / 612 as scale from part where p_size > 0")
def fit_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", text.fit_scale(F.when(k % 3 == 0, size * 40).otherwise(0), F.when(k % 3 == 1, size * 7), F.lit(612.0)).alias("scale"))


@register(
    "image_urls",
    """with p as (select *, p_partkey % 10 as k, p_partkey::varchar || case p_partkey % 4 when 0 then '~mv2.GIF' else '~mv2.png' end as name from part),
      u as (select *, 'https://' || case when k = 3 then 'static.example.com/' else 'm.example.com/media/' end || name as base from p where k in (0, 1, 2, 3, 7))
    select p.p_partkey, base, case when u.p_partkey is not null then base || '/v1/' || case when p.k % 2 = 0 then 'fit' else 'fill' end || '/w_' || least(greatest(u.p_size * 150, 1), 6000) || ',h_' || least(greatest(case when u.k = 0 then u.p_size * 150 else u.p_size * 3 end, 1), 6000)
      || case when u.k % 2 = 0 then '' when u.k = 1 then ',al_c' else ',fp_' || printf('%.2f', (u.p_size % 4) / 4) || '_1.00' end || ',q_' || (80 + u.k) || ',usm_0.66_1.00_0.01,enc_webp,quality_auto/' || case when u.p_partkey % 4 = 0 then u.name else u.p_partkey || '~mv2.webp' end end as url, case p.k when 0 then 'original' else 'fallback' end as next_mode
    from p left join u on u.p_partkey = p.p_partkey""",
)
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of several kinds; those that are not served from known hosts give null."""
    k = F.col("p_partkey") % 10
    name = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 4 == 0, "~mv2.GIF").otherwise("~mv2.png"))
    form = F.element_at(F.array(*map(F.lit, (
        "https://m.example.com/media/{}", "https://m.example.com/media/{}?a=1#b", "HTTPS://M.example.com:443/media/{}/v1/fill/w_1,h_2/x.png", "https://static.example.com/{}/v1/FIT/w_9/y.webp", "http://m.example.com/media/{}",
        "https://me@m.example.com/media/{}", "https://m.example.com:8443/media/{}", "https://m.example.com/media/{}/v1/fit/w_3/z", "https://m.example.com/other/{}", "https://m.example.com/media/{}.svg",
    ))), (k + 1).cast("int"))
    source = text.media_source(F.replace(form, F.lit("{}"), name), _HOSTS)
    rows = table(spark, sf_dir, "part").select("p_partkey", k.alias("k"), F.col("p_size").cast("double").alias("size"), source.alias("s"))
    focus = F.when(F.col("k") > 1, F.struct((F.pmod("size", F.lit(4)) / 4).alias("x"), F.lit(1.5).alias("y")))
    url = text.transform_url(F.col("s"), F.col("size") * 150, F.when(F.col("k") != 0, F.col("size") * 3), F.col("k") % 2 == 1, focus, F.col("k") + 80)
    return rows.select("p_partkey", F.col("s.base").alias("base"), url.alias("url"), text.next_load_mode(F.when(F.col("k") == 0, "optimized").otherwise("original")).alias("next_mode"))


@register("center_distances", "select o_orderkey, sqrt((o_orderkey % 7) * (o_orderkey % 7) + (o_orderkey % 11) * (o_orderkey % 11)) as distance from orders")
def center_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", js.hypot(k % 7, k % 11).alias("distance"))
