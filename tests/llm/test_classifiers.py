"""Language, quality and toxicity: held-out accuracy on the driver tables, and odd rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tallyspark.llm import langid, quality, toxicity
from tallyspark.llm.base import table

FOLDER = entry_points.SMOKE_FOLDER.replace("0.001", "0.01")
here = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
KIND = "doc_id long, text string, lang string, source string, n_chars long, quality string, language int, host int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KIND)


ODD = [
    (None, "the words of a text", "en", "s1", 19), (1, None, None, None, None), (2, "", "en", "s1", 0), (3, "12 345 !!", "en", "s1", 9),
    (4, "word " * 60000, "en", "s2", 300000), (5, "ein Text", "de", "s2", 8), (5, "ein Text", "de", "s2", 8), (6, "ein Text", "de", "s2", 8),
]


def test_language_of_odd_rows(spark):
    rows = langid.identify(langid.document_evidence(docs(spark, ODD)).withColumn("language", F.lit(1)), "row_key", "language")
    found = rows.toDF("row_key", "kept", "language", "posterior", "accepted").collect()
    assert len(found) == len(ODD) and all(r.kept == 1 and 0 <= r.posterior <= 1 for r in found)
    assert sum(r.language == "und" and r.posterior == 0 and not r.accepted for r in found) == 3
    kept = langid.in_known_language(docs(spark, ODD))
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect() if r.doc_id) == [(False, k) for k in (4, 5, 5, 6)]
    assert kept.columns == docs(spark, ODD).columns and kept.where("doc_id IS NULL").count() == 1
    assert langid.in_known_language(docs(spark, [])).collect() == []


def test_declared_language_suffix_and_host_decide_unclear_texts(spark):
    clear = [("der die das und nicht", "de"), ("the of and with this", "en")] * 30
    rows = [(k, t, d, d, f"{d}.example", f"{d}.example") for k, (t, d) in enumerate(clear)]
    rows += [(100, "zq", "de", "de", "de.example", "de.example"), (101, "zq", None, None, "en.example", "en.example"),
             (102, "the of and with this the of and with this", "de", "de", "de.example", "de.example")]
    kind = "id long, text string, declared string, suffix string, domain string, host string"
    found = {r.id: r.language for r in langid.identify(spark.createDataFrame(rows, kind), "id").collect()}
    assert (found[100], found[101], found[102]) == ("de", "en", "en")


def test_rare_languages_are_known(spark):
    # one row in two thousand, or a single one, declares the language
    rows = [(k, "the words of this text are plain and they go on in the same way", "en") for k in range(4000)]
    rows += [(5000, "αυτό είναι ένα κείμενο στα ελληνικά", "el"), (5001, "και αυτό είναι κείμενο στα ελληνικά", "el")]
    rows += [(5002, "lo mbhalo ubhalwe ngolimi lwesizulu futhi mfushane", "zu-ZA"), (5003, "qzx qzx qzx", "nonsense")]
    rows = [(k, t, d, "s", len(t), None, 1, 1) for k, t, d in rows]
    frame = spark.createDataFrame(rows, KIND)
    assert {5000, 5001, 5002} <= {r.doc_id for r in langid.in_known_language(frame).collect()}
    evidence = langid.document_evidence(frame).withColumn("declared_as", F.col("declared"))
    found = langid.identify(evidence, "declared_as").where("declared_as <> 'en'").select("declared_as", "language")
    assert sorted(map(tuple, found.where("declared_as <> 'nonsense'").collect())) == [("el", "el")] * 2 + [("zu-za", "zu")]


@here
def test_languages_of_documents_and_pages(spark):
    rows = table(spark, FOLDER, "documents")
    kept = langid.in_known_language(rows)
    assert kept.count() >= 0.99 * rows.count()
    # texts alone, as their declared languages are hidden where they are asked for
    evidence = langid.page_evidence(table(spark, FOLDER, "pages"))
    asked = F.col("page_id") % 4 == 0
    hidden = evidence.withColumn("truth", F.col("declared")).withColumn("declared", F.when(~asked, F.col("declared")))
    found = langid.identify(hidden, "page_id", "truth").where(asked).collect()
    assert sum(r.language == r.truth for r in found) >= 0.97 * len(found)


@here
def test_quality_of_held_out_documents(spark):
    rows, labels = table(spark, FOLDER, "documents"), table(spark, FOLDER, "labels")
    held = F.col("doc_id") % 3 == 0
    found = quality.quality(rows, labels.where(~held)).join(labels.where(held).withColumnRenamed("quality", "y"), "doc_id").collect()
    assert sum(r.keep == (r.y == 1) for r in found) >= 0.97 * len(found)
    assert sum(r.keep for r in found if r.y == 1) >= 0.99 * sum(r.y == 1 for r in found)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (5, None), (None, 1), (9, 1)], "doc_id long, quality int")
    found = quality.quality(docs(spark, ODD), labels).collect()
    assert len(found) == len(ODD) and all(0 < r.quality < 1 for r in found)
    assert len({r.quality for r in found if r.doc_id == 5}) == 1
    unlabelled = quality.quality(docs(spark, ODD), labels.limit(0)).collect()
    assert all(abs(r.quality - 0.5) < 1e-6 and r.keep for r in unlabelled)
    assert quality.quality(docs(spark, []), labels).collect() == []
    assert quality.of_good_quality(docs(spark, ODD), labels).columns == docs(spark, ODD).columns


def test_labels_of_missing_documents_do_not_widen_the_samples(spark, monkeypatch):
    monkeypatch.setattr(quality, "POOL_ROWS", 20)
    monkeypatch.setattr(quality, "LABELLED_ROWS", 20)
    fitted, fit = [], quality.CoTrained.fit
    monkeypatch.setattr(quality.CoTrained, "fit", lambda self, ids, x, y: fitted.append(y) or fit(self, ids, x, y))
    rows = docs(spark, [(k, f"word {k}", "en", "s1", 6) for k in range(500)])
    labels = spark.createDataFrame([(k, k % 2) for k in [*range(40), *range(1000, 1480)]], "doc_id long, quality int")
    quality.fit(rows, labels)
    known = ~np.isnan(fitted[0])
    assert 8 <= known.sum() <= 32 and 5 <= (~known).sum() <= 60


@here
def test_toxicity_of_held_out_documents(spark):
    folder = FOLDER.replace("0.01", "0.1")
    rows, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = F.col("doc_id") % 3 == 0
    found = toxicity.toxicity(rows, labels.where(~held)).join(labels.where(held).withColumnRenamed("toxic", "y"), "doc_id").collect()
    toxic = [r for r in found if r.y == 1]
    # some toxic labels of the synthetic table have no toxic word
    assert sum(r.is_toxic for r in toxic) >= 0.85 * len(toxic)
    assert sum(r.is_toxic for r in found if r.y == 0) <= 0.01 * len(found)


def test_toxicity_of_odd_rows(spark):
    kind = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 1, 0), (6, None, None), (None, 1, 1), (99, 0, 1)], kind)
    found = toxicity.toxicity(docs(spark, ODD), labels).collect()
    assert len(found) == len(ODD)
    assert all(0 <= p <= 1 for r in found for p in (r.toxic, r.toxic_prose, r.toxic_junk))
    assert toxicity.toxicity(docs(spark, []), labels).collect() == []
    unlabelled = toxicity.toxicity(docs(spark, ODD), labels.limit(0)).collect()
    assert all(abs(r.toxic - 0.5) < 1e-6 for r in unlabelled)
