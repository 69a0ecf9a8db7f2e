"""The pipeline's stages on a small folder: what goes, what stays, which columns."""

import gc
import weakref

import corpus_pipeline
import pytest
from basewise.llm import jaccard_join, quality_classifier, token_files, toxicity
from basewise.llm.common import fold, labels_of, table, vocabulary
from pyspark.sql import functions as F


def test_stages_follow_each_other(spark, small):
    docs = table(spark, small, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "best_fit_packing"]
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    first = corpus_pipeline.quality(spark, docs, small)
    bad = {r.doc_id for r in quality_classifier.classify(docs, labels_of(table(spark, small, "labels"), "quality"), fold(F.col("doc_id"), 5) != 0).where("predicted = 0").collect()}
    assert ids(first) == ids(docs) - bad and first.columns == docs.columns
    second = corpus_pipeline.toxic(spark, first, small)
    bad = {r.doc_id for r in toxicity.classify(first, labels_of(table(spark, small, "labels"), "toxic"), fold(F.col("doc_id"), 4) != 2).where("predicted = 1").collect()}
    assert ids(second) == ids(first) - bad and second.columns == docs.columns
    third = corpus_pipeline.near_duplicates(spark, second, small)
    assert ids(third) <= ids(second) and third.columns == docs.columns
    assert ids(corpus_pipeline.pack(spark, third, small)) == ids(third)
    assert ids(corpus_pipeline.run(spark, small)) == ids(third)


def test_rows_without_id_are_judged_by_their_text(spark, small):
    docs = table(spark, small, "documents")
    gone = docs.join(corpus_pipeline.quality(spark, docs, small).select("doc_id"), "doc_id", "left_anti").limit(1)
    bad, good = gone.withColumn("doc_id", F.lit(None).cast("long")).select(docs.columns), corpus_pipeline.quality(spark, docs, small).limit(1)
    twin = good.withColumn("doc_id", F.lit(gone.first()["doc_id"])).select(docs.columns)  # a clean text under a rejected id
    kept = corpus_pipeline.quality(spark, docs.unionByName(bad).unionByName(twin), small)
    assert kept.where("doc_id is null").count() == 0
    assert [r.text for r in kept.where(F.col("doc_id") == gone.first()["doc_id"]).collect()] == [good.first()["text"]]


class Tasks:
    """Stands for a DataFrame; mapInArrow gives the function itself."""

    def __getattr__(self, name):
        return (lambda f, _: f) if name == "mapInArrow" else lambda *_: self


@pytest.mark.parametrize(
    "task",
    [lambda d: quality_classifier.with_statistics(d), lambda d: jaccard_join.signatures(d, jaccard_join.Params())],
)
def test_workers_free_the_tokenizer_for_the_next_operator(spark, monkeypatch, task):
    d = Tasks()
    monkeypatch.setattr(Tasks, "schema", [], raising=False)
    words = weakref.ref(token_files.Words.of(token_files.Params(vocabulary("word_bpe_49k.json"))))
    assert words() is not None
    list(task(d)(iter(())))
    gc.collect()
    assert words() is None
