"""Queries over phrase dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import drawing
from quillspark.operators.phrases import WORDS, found
from quillspark.plans.registry import register
from quillspark.sources.tables import table

_EVERY = [*drawing.FINISHES, *drawing.MATERIALS, *drawing.NOTES]


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def pairs(benchmark: DataFrame) -> DataFrame:
    """list, rule, phrase, place: every two words of a-z that follow each other in a benchmark item, once, in order of their letters."""
    words = F.split(F.lower("text"), " ")
    two = benchmark.select(F.explode(F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).alias("phrase"))
    once = two.filter(F.col("phrase").rlike("^[a-z]+ [a-z]+$")).distinct()
    return once.select(F.lit("pairs").alias("list"), F.lit(WORDS).alias("rule"), "phrase", F.row_number().over(Window.partitionBy(F.substring("phrase", 1, 1)).orderBy("phrase")).alias("place"))


@register(
    "document_phrases",
    r"""with w as (select string_split(lower(text), ' ') as w from benchmark),
      p as (select phrase, row_number() over (partition by phrase[1] order by phrase)::int as place from (select distinct w[i] || ' ' || w[i + 1] as phrase from (select w, unnest(range(1, len(w))) as i from w)) where regexp_full_match(phrase, '[a-z]+ [a-z]+')),
      d as (select doc_id, '|' || regexp_replace(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\t\n\v\f\r ]+', ' ', 'g'), '([^a-z0-9_])', '|\1|', 'g') || '|' as t from documents),
      m as (select doc_id, phrase, place from d, p where contains(t, '|' || replace(phrase, ' ', '| |') || '|'))
    select doc_id, arg_min(phrase, (place, phrase)) as phrase, min(place) as place, count(*) as n_phrases from m group by doc_id""",
)
def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), pairs(table(spark, sf_dir, "benchmark")), ["doc_id"]).select("doc_id", "phrase", "place", "n_phrases")


@register(
    "part_classes",
    f"""with k as (select p_partkey, p_name, {_list(_EVERY)} as e from part),
      t as (select p_partkey, upper(e[p_partkey % {len(_EVERY)} + 1]) || case p_partkey % 3 when 0 then '  ' when 1 then 'ed, ' else ' ' end || p_name || case p_partkey % 4 when 0 then '' else ' ' || e[p_partkey * 7 % {len(_EVERY)} + 1] end as text,
        string_split(p_name, ' ')[2] as name from k),
      c as (select p_partkey, text, len(list_filter({_list(drawing.FINISHES)}, lambda w: regexp_matches(text, '(?i)\\b' || replace(replace(w, '.', '\\.'), ' ', '\\s+') || '\\b'))) > 0 or regexp_matches(text, '(?i)\\bfinish') as finish,
        len(list_filter({_list(drawing.MATERIALS)}, lambda w: regexp_matches(text, '(?i)\\b' || replace(w, ' ', '\\s+') || '\\b'))) > 0 or (length(name) = 4 and regexp_matches(text, '(?i)\\b' || name || '\\b')) as material, list_filter({_list(drawing.NOTES)}, lambda w: contains(lower(text), w))[1] as note from t)
    select p_partkey, text, case when finish then 'finishes' when material then 'materials' when note is not null then 'notes' else 'unclassified' end as category,
      case when finish or material then null when note is not null then note else trim(text) end as spec from c""",
)
def part_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawing texts of parts, by the fixed keywords and, as materials, the second words of four letters of part names."""
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    every = F.array(*map(F.lit, _EVERY))
    word = lambda k: F.element_at(every, (F.pmod(k, F.lit(len(_EVERY))) + 1).cast("int"))
    text = F.concat(F.upper(word(key)), F.when(key % 3 == 0, "  ").when(key % 3 == 1, "ed, ").otherwise(" "), "p_name", F.when(key % 4 == 0, "").otherwise(F.concat(F.lit(" "), word(key * 7))))
    names = part.select(F.split("p_name", " ")[1].alias("phrase")).filter(F.length("phrase") == 4).distinct().select(F.lit("materials").alias("list"), F.lit(WORDS).alias("rule"), "phrase", F.lit(1000).alias("place"))
    items = part.select("p_partkey", text.alias("text"))
    return drawing.classify_listed(items, drawing.dictionary(spark).unionByName(names)).select("p_partkey", "text", "category", "spec")
