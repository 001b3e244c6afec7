"""From raw documents to packed training sequences.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``; all but the last return the columns of ``documents``.

Defined results of every stage: columns are selected by name, so others may have any names and are left out. Rows with the same id
are told apart by their texts; a row repeated with id and text counts once in the near-duplicate stage, and every time in all
others. A null or empty text is scored by the classifier like any other, has no lines to lose, no near duplicates and no words that a
benchmark holds, and is packed as its end id. A null id stays null; it is never dropped as a copy. An empty table gives an empty
result. Ties go to the smallest id. Very long texts are read whole, each within one task.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, decontamination, line_dedup, ngram_join, packing, quality
from graphloom.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labelled ones among ``docs``."""
    ship_package(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.with_scores(docs.select(*COLUMNS), model).filter("score >= 0.5").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated lines; documents of which nothing is left go."""
    ship_package(spark)
    found = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"[^\t\r\n ]")
    return found.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    ship_package(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    ship_package(spark)
    return decontamination.clean_documents(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4096 ids."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: Model training, the tokenizer and the packing are not SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's result written in the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
