"""Queries over whole tables, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import conversations, langid, oracles, pieces, pii, quality, secrets
from quillspark.llm.ann import nearest
from quillspark.llm.decontaminate import EXCERPTS, leaks
from quillspark.llm.hard_negatives import hard_negatives, quantized
from quillspark.llm.mixing import mix
from quillspark.llm.ngram_join import ngram_components
from quillspark.llm.token_counts import count_tokens
from quillspark.llm.token_output import token_output


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, k=5)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_documents(spark, sf_dir)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), EXCERPTS)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), limit=512)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), weights=(5, 2, 1))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_documents(spark, sf_dir), end_id=2)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_documents(spark, sf_dir), words=4, percent=85)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(_documents(spark, sf_dir), decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_secrets, op2_nearest, op3_personal_data, op4_quality, op5_decontaminate, op6_language_id, op7_token_counts, op8_mix_sources, op9_token_output, op10_ngram_join)
    return {f.__name__: f for f in (*ops, op11_sentencepiece, op12_conversation_repair, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix_sources": oracles.MIX, "op10_ngram_join": oracles.NGRAM_JOIN, "op12_conversation_repair": oracles.REPAIR, "op13_hard_negatives": oracles.NEGATIVES}
