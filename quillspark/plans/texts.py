"""Queries over formatting and URL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import js, text
from quillspark.plans.registry import register
from quillspark.sources.tables import table


@register(
    "url_functions",
    """select page_id, '/' || replace(replace(url, 'http://', ''), ' ', '-') as page, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') as file_name,
      lower(regexp_replace(upper(left(url, 3)) || 'Id', '([A-Z])', '_\\1', 'g')) as snake,
      coalesce(nullif(regexp_extract(url, '[?&]ref=([^&]*)', 1), ''), nullif(case when page_id % 2 = 0 then 'dflt' else '' end, ''), 'kept') as ref from pages""",
)
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    given = F.regexp_extract(u, "[?&]ref=([^&]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", text.page_url(F.replace(u, F.lit("http://"), F.lit(""))).alias("page"), text.file_name(u).alias("file_name"), text.snake(F.concat(F.upper(F.left(u, F.lit(3))), F.lit("Id"))).alias("snake"), text.resolved(given, F.when(F.col("page_id") % 2 == 0, "dflt").otherwise(""), F.lit("kept")).alias("ref"))


#: What stands before and after a page's own path in each kind of address, and what a browser makes of it: "own" (path and query), "path" (its path), or a fixed answer.
RETURN_FORMS = (
    ("", "", "own"), ("https://app.example.com", "", "own"), ("HTTPS://App.Example.com:443", "", "own"), (" \t", " ", "own"), ("/x/..", "", "own"), ("/%2E", "", "own"), ("/a/b/.%2e/../%2e", "", "own"), ("https:\\\\app.example.com", "", "own"), ("https://me@app.example.com", "", "own"),
    ("//evil.example.com", "", "/"), ("/\t/evil.example.com", "", "/"), ("/.//evil.example.com", "", "/"), ("/a/..//evil.example.com", "", "/"), ("\\/evil.example.com", "", "/"), ("http://app.example.com", "", "/"), ("https://app.example.com:8443", "", "/"), ("https://app.example.com.evil.example.com", "", "/"),
    ("https://app.example.com@evil.example.com", "", "/"), ("javascript:", "", "/"), ("https://app.example.com", "#?app_id=1", "own"), ("x/../..", "", "own"), ("", "/./", "slash"),
)


def _quoted(x: str) -> str:
    return "'" + x.replace("\t", "' || chr(9) || '") + "'"


@register(
    "safe_return_path",
    # each kind's answer is known from how it was put together, so nothing is parsed here but the page's own address, which is plain
    f"""with u as (select page_id, regexp_extract(url, '^https?://[^/]*([^?#]*)', 1) as path, regexp_extract(url, '[?]([^#]*)', 1) as q from pages),
      f as (select unnest(range({len(RETURN_FORMS)})) as k, unnest([{", ".join(_quoted(a) for a, _, _ in RETURN_FORMS)}]) as before, unnest([{", ".join(_quoted(b) for _, b, _ in RETURN_FORMS)}]) as after, unnest([{", ".join(_quoted(c) for _, _, c in RETURN_FORMS)}]) as kind),
      d as (select *, case page_id % 3 when 0 then '' when 1 then 'app_id=9&' else '%66rom%5Furl=http://evil.example.com&' end as dropped from u)
    select page_id, before || path || case when kind = 'slash' then after else '' end || case when q || dropped = '' then '' else '?' || dropped || q end || case when kind <> 'slash' then after else '' end as raw,
      case kind when '/' then '/' else path || case when kind = 'slash' then '/' else '' end || case when q = '' then '' else '?' || q end end as path
    from d join f on f.k = page_id % {len(RETURN_FORMS)}""",
)
def safe_return_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    before, after, kind = (F.element_at(F.array(*[F.lit(f[n]) for f in RETURN_FORMS]), (F.col("page_id") % len(RETURN_FORMS) + 1).cast("int")) for n in range(3))
    path, query = F.regexp_extract(u, "^https?://[^/]*([^?#]*)", 1), F.regexp_extract(u, "[?]([^#]*)", 1)
    dropped = F.element_at(F.array(F.lit(""), F.lit("app_id=9&"), F.lit("%66rom%5Furl=http://evil.example.com&")), (F.col("page_id") % 3 + 1).cast("int"))
    asked = F.when(F.concat(query, dropped) == "", "").otherwise(F.concat(F.lit("?"), dropped, query))
    raw = F.when(kind == "slash", F.concat(before, path, after, asked)).otherwise(F.concat(before, path, asked, after))
    return table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), text.return_path(raw, "https://app.example.com").alias("path"))


@register(
    "media_urls",
    """with p as (select p_partkey, 'https://m.example.com/' || p_partkey || '.png' as base, p_partkey::varchar || case when p_partkey % 9 = 0 then '.GIF' else '.png' end as name, p_size as w from part)
    select p_partkey, """
    + " || ', ' || ".join(f"base || '/v1/fit/w_' || least(greatest(w * {r}, 1), 6000) || ',h_' || least(greatest(w * {r}, 1), 6000) || ',q_80,usm_0.66_1.00_0.01,enc_webp,quality_auto/' || case when p_partkey % 9 = 0 then name else p_partkey || '.webp' end || ' {r}x'" for r in text.PIXEL_RATIOS)
    + " as srcset from p",
)
def media_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    name = F.concat(k, F.when(F.col("p_partkey") % 9 == 0, ".GIF").otherwise(".png"))
    return table(spark, sf_dir, "part").select("p_partkey", text.source_set(F.concat(F.lit("https://m.example.com/"), k, F.lit(".png")), name, F.col("p_size"), F.lit(None).cast("int")).alias("srcset"))


@register(
    "misc_scalars",
    """select o_orderkey, o_orderkey % 1000 as parsed, case when o_orderkey % 5 = 0 then 'n/a' else ((o_orderkey % 100))::varchar || '%' end as confidence, replace(lower(o_orderpriority), '_', ' ') as label,
      sqrt((o_orderkey % 7) * (o_orderkey % 7) + (o_orderkey % 11) * (o_orderkey % 11)) as distance from orders""",
)
def misc_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        js.leading_number(F.concat(F.lit(" "), (k % 1000).cast("string"), F.lit("abc"))).cast("long").alias("parsed"),
        text.percent(F.when(k % 5 != 0, (k % 100) / 100.0)).alias("confidence"),
        text.spaced(F.lower("o_orderpriority")).alias("label"),
        js.hypot(k % 7, k % 11).alias("distance"),
    )


@register("grouped_numbers", "select c_custkey, format('{:,}', c_custkey * 1237) as grouped, cast(c_custkey as varchar) || '.5' as plain from customer")
def grouped_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", js.grouped_text(k * 1237).alias("grouped"), js.number_text(k + 0.5).alias("plain"))
