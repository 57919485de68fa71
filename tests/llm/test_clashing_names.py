"""The pipeline's stages keep columns that are named like those they use inside."""

import pytest

import corpus_pipeline
from tallyspark.llm import decontamination, langid

NAMES = ["row_key", "row_key0", "_row_key", "ROW_KEY1", "kept_id", "_kept_id", "link_id", "id", "root", "tokens", "declared"]


@pytest.fixture(scope="module")
def docs(spark):
    text = "the quick brown fox jumps over the lazy dog and runs back to the quiet house by the river in the evening sun"
    rows = [(k, f"{text} number {k}", "en", "site", 5, *[f"{n}-{k}" for n in NAMES]) for k in range(30)]
    extra = ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def same_rows(kept, docs):
    assert kept.columns == docs.columns
    want = {tuple(r) for r in docs.collect()}
    found = [tuple(r) for r in kept.collect()]
    assert set(found) <= want
    return len(found)


def test_language(docs):
    assert same_rows(langid.in_known_language(docs), docs) == 30


def test_decontamination(spark, docs):
    benchmark = spark.createDataFrame([(1, docs.where("doc_id = 3").first().text + " and some more words")], "item_id long, text string")
    assert same_rows(decontamination.without_benchmark(docs, benchmark), docs) < 30
    assert same_rows(decontamination.without_benchmark(docs, benchmark.limit(0)), docs) == 30


def test_near_duplicates(spark, docs):
    assert 1 <= same_rows(dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, ""), docs) <= 30
