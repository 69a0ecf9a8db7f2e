"""The corpus pipeline: quality classifier, toxicity, near duplicates, packing.

Each stage takes what the one before it kept. The first three return the columns of
documents: rejected documents are gone; the last returns a row for each packed piece.

Defined cases: a row is told apart from others by its doc_id and its text, so of rows that
share an id each stands for itself, and rows without an id are judged like any other.
Repeated rows share their verdicts; of near duplicates, copies among them, one row stays,
the one with the least doc_id. Null and empty texts are judged by the classifiers; those
that they keep are in no class of duplicates and have nothing to pack. Very long texts are
read whole. An empty table gives an empty table at every stage, and where nothing is
labelled the classifiers learn nothing: quality then keeps every document (score 0.5) and
toxicity too (score 0). Further columns of documents, whatever their names, stay until
packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise.llm import jaccard_join, packing, quality_classifier, toxicity
from basewise.llm.common import fold, labels_of, shared_dir, table, without_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    labels = labels_of(table(spark, sf_dir, "labels"), "quality")
    return without_rows(docs, quality_classifier.classify(docs, labels, fold(F.col("doc_id"), 5) != 0).where("predicted = 0"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    labels = labels_of(table(spark, sf_dir, "labels"), "toxic")
    return without_rows(docs, toxicity.classify(docs, labels, fold(F.col("doc_id"), 4) != 2).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.drop_near_duplicates(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("toxicity", toxic), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", pack)]

#: Fitted models, signatures and best-fit placement are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
