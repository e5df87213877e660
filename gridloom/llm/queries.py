"""The thirteen operators as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import audit, bpe, chat, decontaminate, language, neighbours, records, score, shard, simhash, substring, variants, warc
from gridloom.llm.common import load
from gridloom.llm.oracles import SQL

SHARDS = 40


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.match_items(docs, load(spark, sf_dir, "benchmark"), carry_text=False))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(load(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(load(spark, sf_dir, "documents"))


#: A conversation made of control strings, added to those of the table.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(turns.unionByName(planted)))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(load(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(load(spark, sf_dir, "documents"))


def op7_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.score_documents(load(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(load(spark, sf_dir, "pages"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors.filter("vec_id % 50 = 0"), vectors)


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(load(spark, sf_dir, "documents"), SHARDS)


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(load(spark, sf_dir, "documents"))


def op13_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.digest(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_substring, op3_language, op4_chat, op5_simhash, op6_bpe, op7_score, op8_warc, op9_neighbours, op10_shard, op11_audit, op12_variants, op13_records)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
