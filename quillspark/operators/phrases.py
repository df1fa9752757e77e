"""Which phrases of a dictionary table occur in texts. The dictionary is a trie of few levels, kept as tables: heads, what phrases begin with, with the
sizes that phrases under them have, and the phrases themselves. A text's places meet the heads, and what is cut there in those sizes meets the phrases;
both are equality joins, so a place costs as many cuts as its head has sizes, however many phrases there are.

Phrases between word boundaries are counted in runs, of word characters or of others, and their head is the first run. Phrases anywhere are counted
in characters, and their head is half of them or more, up to 24.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.js import WS, trim

#: Rules: between word boundaries with any white space for a space, and anywhere in the text as it is. Neither minds case.
WORDS, ANYWHERE = "words", "anywhere"
HEADS = (1, 3, 6, 12, 24)
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(WS, c))
#: Of a folded text; Java matches its own classes some ten times as fast as ones written out.
RUN = r"\w++|\W++"
#: Characters of a text's pieces, at least. A place anywhere looks into its piece by character, so those are short.
PIECE = {WORDS: 4096, ANYWHERE: 64}
#: Heads, and phrases, are sent to every task if they are no more than these, of phrases no longer than that: below 40 MB each. Else they are joined by a shuffle.
LONGEST_SENT = 256
SENT = 100_000


def _folded(text: Column, rule: str) -> Column:
    if rule == ANYWHERE:
        return F.lower(text)
    return F.regexp_replace(F.translate(text, string.ascii_uppercase + SPACES, string.ascii_lowercase + " " * len(SPACES)), "  +", " ")


def _is_word(c: Column) -> Column:
    """Whether a folded text begins with a letter of a-z, a digit or _."""
    code = F.ascii(c)
    return code.between(97, 122) | code.between(48, 57) | (code == 95)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUN), F.lit(0))


def _tables(dictionary: DataFrame) -> tuple[DataFrame, DataFrame, bool, list[int], dict[str, tuple[int, int]]]:
    """Heads (rule, head, sizes), phrases (rule, phrase, list, place), whether these are sent to every task, the lengths of heads of phrases anywhere,
    and the largest size and length by rule."""
    known = F.when(F.col("rule").isin(WORDS, ANYWHERE), F.col("rule")).otherwise(F.raise_error(F.concat(F.lit("no rule: "), F.coalesce("rule", F.lit("null")))).cast("string"))
    folded = F.when(known == WORDS, trim(_folded(F.col("phrase"), WORDS))).otherwise(_folded(F.col("phrase"), ANYWHERE))
    rows = dictionary.select(known.alias("rule"), folded.alias("phrase"), "list", "place").filter(F.length("phrase") > 0)
    phrases = rows.groupBy("rule", "phrase", "list").agg(F.min("place").alias("place"))
    length, words = F.length("phrase"), F.col("rule") == WORDS
    h = F.when(~words, F.coalesce(*[F.when(length >= n, n) for n in reversed(HEADS)]))
    head = F.when(words, F.get(_runs(F.col("phrase")), F.lit(0))).otherwise(F.substr("phrase", F.lit(1), h))
    headed = rows.select("rule", F.when(words, F.size(_runs(F.col("phrase")))).otherwise(length).alias("size"), length.alias("length"), h.alias("h"), head.alias("head"))
    found = headed.groupBy("rule").agg(F.collect_set("h").alias("h"), F.max("size").alias("size"), F.max("length").alias("length"), F.count_distinct("head").alias("n"), F.count("*").alias("all")).collect()
    heads = headed.groupBy("rule", "head").agg(F.collect_set("size").alias("sizes"))
    short = all(r["length"] <= LONGEST_SENT for r in found)
    if short and sum(r["n"] for r in found) <= SENT:
        heads = F.broadcast(heads)
    if sent := short and sum(r["all"] for r in found) <= SENT:
        phrases = F.broadcast(phrases)
    return heads, phrases, sent, sorted({h for r in found for h in r["h"]}), {r["rule"]: (r["size"], r["length"]) for r in found}


def _pieces(texts: DataFrame, keys: list[str], text: Column, pattern: str, most: int) -> DataFrame:
    """keys, _own, _ahead, _first: texts cut into pieces in linear time, with the ``most`` characters that follow, so that a place never carries its whole text."""

    def cut(a: Column) -> Column:
        ahead = lambda i: F.substring(F.coalesce(F.get(a, i + 1), F.lit("")), 1, most)
        return F.transform(a, lambda x, i: F.struct(x.alias("own"), ahead(i).alias("ahead"), (i == 0).alias("first")))

    rows = texts.select(*keys, F.explode(F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), cut)[0]).alias("_p"))
    return rows.select(*keys, *[F.col(f"_p.{c}").alias(f"_{c}") for c in ("own", "ahead", "first")])


def _word_cuts(texts: DataFrame, heads: DataFrame, keys: list[str], text: Column, most: int, longest: int, piece: int) -> DataFrame:
    """keys, phrase: what may be a phrase of up to ``most`` runs and ``longest`` characters between word boundaries."""
    # a piece ends where a run does; one character more shows whether a run ends with the phrase
    rows = _pieces(texts, keys, text, f"(?s).{{1,{max(piece, longest + 1)}}}(?:(?<=\\w)\\w*+|(?<=\\W)\\W*+)", longest + 1)
    rows = rows.select(*keys, _runs(F.concat("_own", "_ahead")).alias("_all"), F.size(_runs(F.col("_ahead"))).alias("_behind"), "_first")
    # runs are exploded by themselves, and cut only where a head is met: without lambdas, one generated loop does all of it; an outer explode
    # has no filter put before it that would match all runs again
    at = rows.select(*keys, "_all", "_first", (F.size("_all") - F.col("_behind")).alias("_n"), F.posexplode_outer("_all").alias("_at", "_head")).filter(F.col("_at") < F.col("_n"))
    at = at.filter(~F.col("_first") | (F.col("_at") > 0) | _is_word(F.col("_head"))).select(*keys, "_head", F.slice("_all", F.col("_at") + 1, F.lit(most + 1)).alias("_runs"))
    met = at.join(heads, "_head").select(*keys, "_runs", F.explode("sizes").alias("_size"))
    phrase = F.array_join(F.slice("_runs", F.lit(1), F.col("_size")), "")
    whole = met.filter(F.size("_runs") >= F.col("_size")).select(*keys, phrase.alias("phrase"), (F.size("_runs") > F.col("_size")).alias("_more"))
    return whole.filter(F.col("_more") | _is_word(F.substring("phrase", -1, 1))).select(*keys, "phrase")


def _cuts(texts: DataFrame, heads: DataFrame, keys: list[str], text: Column, lengths: list[int], most: int, piece: int) -> DataFrame:
    """keys, phrase: what may be a phrase of up to ``most`` characters anywhere."""
    rows = _pieces(texts, keys, text, f"(?s).{{1,{max(piece, most)}}}", most)
    rows = rows.select(*keys, F.concat("_own", "_ahead").alias("_t"), F.explode(F.sequence(F.lit(1), F.length("_own"))).alias("_at"))
    rows = rows.select(*keys, F.substr("_t", F.col("_at"), F.lit(most)).alias("_rest"), F.explode(F.array(*map(F.lit, lengths))).alias("_h"))
    at = rows.filter(F.length("_rest") >= F.col("_h")).select(*keys, "_rest", F.substr("_rest", F.lit(1), F.col("_h")).alias("_head"))
    met = at.join(heads, "_head").select(*keys, "_rest", F.explode("sizes").alias("_size"))
    return met.filter(F.length("_rest") >= F.col("_size")).select(*keys, F.substr("_rest", F.lit(1), F.col("_size")).alias("phrase"))


def found(texts: DataFrame, dictionary: DataFrame, keys: list[str], text: str = "text", piece: int | None = None) -> DataFrame:
    """keys, list, phrase, place, n_phrases, n_found: of each text and list of ``dictionary`` (list, rule, phrase, place) the phrase of least place that
    occurs, by phrase where places tie, how many different phrases occur, and how often any does, overlaps included.

    Phrases come back in small letters; a phrase that a list repeats has its least place; empty and null ones never occur. Texts without a phrase,
    empty or null, give no row. Rows with equal keys, null ones too, count as parts of one text. Other columns are ignored; keys must not bear a name
    of the result. An unknown rule is an error, as is an empty ``keys``. Texts are dealt anew among tasks, as a file
    of few row groups is read by as few. ``piece`` is the least length of the pieces that texts are cut into; the result doesn't depend on it.
    A phrase's length bounds what a row holds, so dictionaries of whole documents are not for this.
    """
    names = ["list", "phrase", "place", "n_phrases", "n_found"]
    if not keys or set(keys) & set(names):
        raise ValueError(f"keys must be given, and none of them be one of {', '.join(names)}")
    heads, phrases, sent, lengths, most = _tables(dictionary)
    dealt = texts.select(*keys, F.col(text).alias("_whole")).repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = None
    for rule, (size, longest) in most.items():
        own, whole, least = heads.filter(F.col("rule") == rule).select(F.col("head").alias("_head"), "sizes"), _folded(F.col("_whole"), rule), piece or PIECE[rule]
        cuts = _word_cuts(dealt, own, keys, whole, size, longest, least) if rule == WORDS else _cuts(dealt, own, keys, whole, lengths, size, least)
        # phrases that are at hand are met at once; for others, what a text repeats is sent once
        counted = cuts.withColumn("_n", F.lit(1)) if sent else cuts.groupBy(*keys, "phrase").agg(F.count("*").alias("_n"))
        part = counted.join(phrases.filter(F.col("rule") == rule).drop("rule"), "phrase").select(*keys, "list", "phrase", "place", "_n")
        met = part if met is None else met.unionByName(part)
    if met is None:
        return texts.select(*keys, *[F.lit(None).cast(t).alias(n) for n, t in zip(names, ("string", "string", "int", "long", "long"), strict=True)]).filter(F.lit(False))
    once = met.groupBy(*keys, "list", "phrase").agg(F.min("place").alias("place"), F.sum("_n").alias("_n"))
    best = once.groupBy(*keys, "list").agg(F.min(F.struct("place", "phrase")).alias("_b"), F.count("*").alias("n_phrases"), F.sum("_n").alias("n_found"))
    return best.select(*keys, "list", "_b.phrase", "_b.place", "n_phrases", "n_found")
