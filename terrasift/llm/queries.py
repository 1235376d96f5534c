"""The registered queries of this subpackage: thin wrappers over the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm import chat, decontaminate, katz, language, linear, media, mixing, pii, simhash
from terrasift.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 4) != 2)
    out = linear.quality_scores(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", linear.accepted(F.col("score"), 0.7).alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    out = linear.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", linear.accepted(F.col("score"), 0.5).alias("predicted"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(more)))


def op6_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) != 1)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language.predict(docs, language.learn(docs.where(crc_mod(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the images rendered from the whole embeddings table, which is the media column here."""
    found = media.copies(media.rendered(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "class_id")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_mixing, op3_quality, op4_toxicity, op5_chat, op6_katz, op7_language, op8_pii, op9_media, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE}
