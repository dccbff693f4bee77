"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_substring, licenses, media, ngram_lm, packing, quality, sharding, simhash, spelling, token_shards, toxicity
from .common import table


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.from_media(media.to_media(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("id", "doc_id").drop("error")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substring.report(table(spark, sf_dir, "documents"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score_corpus(table(spark, sf_dir, "documents"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontaminate_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.loose_openings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.through_shards(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate, "op2_packing": op2_packing,
    "op3_quality": op3_quality, "op4_media": op4_media, "op5_toxicity": op5_toxicity, "op6_lm": op6_lm, "op7_token_shards": op7_token_shards,
    "op8_substring": op8_substring, "op9_simhash": op9_simhash,
    "op10_licenses": op10_licenses, "op11_spelling": op11_spelling, "op12_sharding": op12_sharding,
    "decontaminate_proximity": decontaminate_proximity,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE, "op8_substring": exact_substring.ORACLE, "op10_licenses": licenses.ORACLE,
    "op11_spelling": spelling.ORACLE, "op12_sharding": sharding.ORACLE,
    "decontaminate_proximity": decontaminate.PROXIMITY_ORACLE,
}
