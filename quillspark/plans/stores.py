"""Queries over store filters, notices and recognition providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import filters
from quillspark.operators.providers import Registry
from quillspark.plans.registry import register
from quillspark.sources.tables import table
from quillspark.streaming import notices as N

_FILTERS = {"none": "{}", "segment": '{"c_mktsegment": "BUILDING", "c_nationkey": 3}', "prefix": {"c_name": {"$regex": "^Customer#00000[01]"}}, "literal": filters.starting_with("c_name", "Customer#000000.1"), "missing": '{"c_name": null}'}


@register(
    "store_filters",
    """select 'none' as filter, c_custkey from customer union all select 'segment', c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 3
    union all select 'prefix', c_custkey from customer where starts_with(c_name, 'Customer#000000') or starts_with(c_name, 'Customer#000001')""",
)
def store_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, document in _FILTERS.items():
        found = table(spark, sf_dir, "customer").filter(filters.condition(document)).select(F.lit(name).alias("filter"), "c_custkey")
        out = found if out is None else out.unionByName(found)
    return out


def _actions(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    kind: Column = F.when(k % 10 < 5, "ADD").when(k % 10 < 7, "UPDATE").when(k % 10 < 9, "DISMISS").otherwise("REMOVE")
    which = F.when((kind == "ADD") | (k % 30 < 29), (k % 13).cast("string"))
    return events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), k.alias("seq"), kind.alias("kind"), which.alias("id"), F.when(k % 4 != 0, F.col("event_type")).alias("title"))


@register(
    "notice_states",
    """with recursive a as (select user_id, epoch_us(ts) as moment, event_id as k, case when event_id % 10 < 5 then 'ADD' when event_id % 10 < 7 then 'UPDATE' when event_id % 10 < 9 then 'DISMISS' else 'REMOVE' end as kind, case when event_id % 4 <> 0 then event_type end as title,
        row_number() over (partition by user_id order by epoch_us(ts), event_id) as pos from events),
      b as (select *, case when kind = 'ADD' or k % 30 < 29 then (k % 13)::varchar end as id from a),
      s(user_id, pos, held) as (select distinct user_id, 0::bigint, []::struct(id varchar, title varchar, open boolean, due bigint)[] from b
        union all select user_id, pos, case kind when 'ADD' then (list_prepend({'id': id, 'title': title, 'open': true, 'due': null::bigint}, live))[1:20]
            when 'UPDATE' then list_transform(live, lambda n: {'id': n.id, 'title': case when n.id = b_id then coalesce(title, n.title) else n.title end, 'open': n.open, 'due': n.due})
            when 'DISMISS' then list_transform(live, lambda n: {'id': n.id, 'title': n.title, 'open': n.open and not (b_id is null or n.id = b_id), 'due': case when b_id is null or n.id = b_id then coalesce(n.due, moment + 1000000000) else n.due end})
            else list_filter(live, lambda n: b_id is not null and n.id <> b_id) end
          from (select b.*, b.id as b_id, list_filter(s.held, lambda n: n.due is null or n.due > b.moment) as live from s join b on b.user_id = s.user_id and b.pos = s.pos + 1))
    select user_id, (place - 1)::int as place, held[place].id as id, held[place].title as title, held[place].open as open
    from (select user_id, held, unnest(range(1, len(held) + 1)) as place from s where pos = (select max(b.pos) from b where b.user_id = s.user_id))""",
)
def notice_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.notices(_actions(table(spark, sf_dir, "events")))


def _lines(content: str) -> list[str]:
    return [x for x in content.split("\n") if x]


def _plain_only(content: str) -> list[str]:
    if not content.isascii():
        raise ValueError("not ASCII")
    return content.split(" ")


@register(
    "provider_items",
    """with p as (select doc_id, text, case doc_id % 3 when 0 then 'plain' else 'lines' end as provider from documents)
    select doc_id as page, provider, (i - 1)::int as place, parts[i] as text, null::varchar as error from (select *, unnest(range(1, len(parts) + 1)) as i from (select *, case provider when 'plain' then string_split(text, ' ') else list_filter(string_split(text, chr(10)), lambda x: x <> '') end as parts
      from p where provider = 'lines' or length(text) = strlen(text)))
    union all select doc_id, provider, -1, null, 'ValueError: not ASCII' from p where provider = 'plain' and length(text) <> strlen(text)""",
)
def provider_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: a third by a provider that fails on some, a third by an unknown name, a third without one."""
    registry = Registry("lines")
    registry.register("lines", _lines)
    registry.register("plain", _plain_only)
    name = F.when(F.col("doc_id") % 3 == 0, "plain").when(F.col("doc_id") % 3 == 1, "no such provider")
    return registry.recognised(table(spark, sf_dir, "documents").withColumn("provider", name), "doc_id", "provider", "text")
