"""From raw documents to packed training sequences, a stage at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stockflow.llm import common, decontaminate, language_id, near_dup, packing, secrets


# Documents have doc_id, text, lang, source, n_chars, and perhaps other columns; each stage keeps them all, whatever their names. Rows that repeat go through
# each stage one by one. A null text, and one without words, is kept by every stage and has one token, its end, in the last. A stage of an empty table gives one.


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language that the corpus is labelled with; lang is then the language found. Null and empty texts stay, with their lang."""
    return language_id.in_known_language(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike, that of the smallest doc_id stays. Texts without words are like none; rows without a doc_id stay."""
    return near_dup.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark, also one with a few edits. An empty benchmark drops none."""
    return decontaminate.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks live-looking secrets in the texts, whose n_chars follow. Without a source a secret counts as its own."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each in its sequence."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_near_duplicates),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: SQL expresses neither the tokenizer nor the plan of packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is a table in the shared folder, which the next one reads; it goes once that one is written."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        rows, path = stage(spark, docs, sf_dir), common.new_path(spark, f"stage-{name}")
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if last:
            common.remove(spark, last)
        last = path
    return docs
