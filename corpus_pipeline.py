"""The documents' way through five of the operators.

Each stage takes (spark, docs, sf_dir), works on all of ``docs`` and returns those it
keeps with the columns of ``documents``; the last returns the packed pieces.

Rows are judged each by their own text, so that neither a missing nor a repeated doc_id
decides: of rows that repeat, the first of the table stays.  Where rows have to be named,
``near_copies`` takes their places in the scan; ``docs`` is a written table there, which every
scan cuts alike.  Null and empty texts have no language and leave at the first stage.  Empty
tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import bagminhash, decontam, langid, linededup, packing
from postloom.llm.base import materialise, release, table

#: Below this mean marginal a document has no language of its own.
LEAST_LANGUAGE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words the field gives to a language; texts without letters and undecided ones go."""
    return langid.keep(docs, langid.train(docs), LEAST_LANGUAGE)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a text of which nothing with a word is left goes."""
    left = linededup.dedup_lines(docs).where((F.col("_line_gone") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the first of the table."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    first = bagminhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text")).where("doc_id = class_id")
    return rows.join(first.select(F.col("doc_id").alias("_row")), "_row", "left_semi").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences, with their ids."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", language),
    ("repeated_lines", repeated_lines),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("packed", packed),
]
ORACLE_SQL = None  # the stages' models have no SQL; tests hold each against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, name)
            release(before)
    return docs
