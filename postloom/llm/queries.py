"""The operators' registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bagminhash, dac, decontam, kneserney, langid, linededup, packing, rules, sanitise, secrets
from .base import table


def op1_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.withColumn("held_out", langid.held_out())


def op2_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "_line_total as n_lines", "_line_gone as n_deleted", "text")


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op6_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_dac_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.round_trip(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_crf": op1_language_crf,
    "op2_bagminhash": op2_bagminhash,
    "op3_line_runs": op3_line_runs,
    "op4_disclosure": op4_disclosure,
    "op7_kneser_ney": op7_kneser_ney,
    "op6_latent_leaks": op6_latent_leaks,
    "op5_secret_forest": op5_secret_forest,
    "op8_quality_trees": op8_quality_trees,
    "op9_packing": op9_packing,
    "op10_dac_ids": op10_dac_ids,
}
ORACLES: dict[str, str] = {"op3_line_runs": linededup.ORACLE}
