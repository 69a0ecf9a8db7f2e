"""The queries of this subpackage: one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe_tree, class_lm, jaccard_join, language_id, merkle, packing, quality_classifier, quality_rules, stable_ann, token_files, toxicity, url_reputation
from .common import fold, labels_of, shared_dir, table, vocabulary
from .sql import SQL

URL_RULES = tuple(
    url_reputation.Rule(*x)
    for x in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 0
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def _scores(spark: SparkSession, sf_dir: str, classify: Callable, label: str, folds: int, held: int) -> DataFrame:
    """Scores of all documents, learnt from the labels outside the held-out fold."""
    of = fold(F.col("doc_id"), folds)
    scored = classify(table(spark, sf_dir, "documents"), labels_of(table(spark, sf_dir, "labels"), label), of != held)
    return scored.select("doc_id", F.coalesce(of == held, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, quality_classifier.classify, "quality", 5, 0)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir, toxicity.classify, "toxic", 4, 2)


def op7_bpe_tree(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return bpe_tree.digests(table(spark, sf_dir, "documents"), bpe_tree.Params(tokenizer or vocabulary("byte_bpe_50k.json")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document that its path names: /<lang>/<doc_id>."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    named = pages.select(url_reputation.host_of(F.col("url")).alias("host"), F.regexp_extract(url_reputation.path_of(F.col("url")), r"^/[a-z]+/([0-9]{1,18})", 1).alias("doc_id"))
    named = named.where("doc_id <> ''").withColumn("doc_id", F.col("doc_id").cast("long"))
    outcomes = named.join(labels_of(table(spark, sf_dir, "labels"), "quality"), "doc_id").select("host", F.col("label").alias("outcome"))
    return url_reputation.judge_urls(pages, outcomes, URL_RULES)


def op9_stable_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stable_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, token_files.Params(tokenizer or vocabulary("word_bpe_49k.json")))
    return token_files.read(spark, path)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the documents whose id's crc32 is divisible by 3, a text in lower case is held against the manifest; of the others the text as it is."""
    made = merkle.manifest(table(spark, sf_dir, "documents"), more={"tampered": merkle.tampered_leaf})
    found = merkle.verify(made, F.coalesce("tampered", "leaf"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_brown_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = fold(F.col("doc_id"), 5)
    found = class_lm.score(table(spark, sf_dir, "documents"), of != 1)
    held = F.coalesce(of == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op13_token_alignment(spark: SparkSession, sf_dir: str, a: str | None = None, b: str | None = None) -> DataFrame:
    p = alignment.Params(a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model"))
    return alignment.digests(table(spark, sf_dir, "documents"), p)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
