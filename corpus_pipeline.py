"""A training-data pipeline in five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, line_dedup, mixing, packing
from tidemark.llm.common import written

#: A document goes if it has no letter or if no language reaches this calibrated probability.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, model, names=("__lang", "__score"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the smallest doc_id, and one of those that the stage before left without a word;
    documents without a doc_id stay."""
    gone = jaccard.near_duplicates(docs, wordless_apart=False).where("doc_id != class_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL can say neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
