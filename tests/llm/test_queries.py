"""The registered queries on the smallest driver tables: SQL where there is some, else whole results; the pipeline."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from tallyspark.llm import langid, quality, queries, similar
from tallyspark.llm.base import table
from tests.llm.test_decontamination import overlaps, tokens
from tests.llm.test_simhash import groups_of
from tests.oracle import compare, connect

FOLDER = entry_points.SMOKE_FOLDER
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")

ROWS = {
    "op4_simhash_near_copies": "documents", "op5_toxicity_chain": "documents", "op6_token_files": "documents",
    "op8_quality_cotraining": "documents", "op9_bpe_round_trip": "documents", "op10_language_id": "pages",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = entry_points.queries()[name](spark, FOLDER)
    if name in queries.ORACLES:
        assert compare(frame, connect(FOLDER), entry_points.oracle_sql()[name]) is None
    elif name in ROWS:
        assert frame.count() == table(spark, FOLDER, ROWS[name]).count()
    else:
        assert frame.count() > 0


def test_pipeline_matches_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    known = {r.row_key for r in langid.identify(langid.document_evidence(docs), "row_key").where("accepted").collect()}
    rows = [r for r in docs.withColumn("row_key", langid.row_key()).collect() if r.row_key in known]
    kept = spark.createDataFrame([r[:5] for r in rows], docs.schema)
    good = {r.doc_id for r in quality.quality(kept, table(spark, FOLDER, "labels")).where(F.col("keep")).collect()}
    texts = {r.doc_id: r.text for r in rows if r.doc_id in good}
    sets = {k: set(similar.shingle_set(t.encode()).tolist()) for k, t in texts.items()}

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    firsts = set(groups_of(sorted(texts), alike).values())
    items = [tokens(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {k for k in firsts if not any(set(tokens(texts[k])) >= set(i[:3]) and overlaps(tokens(texts[k]), i) for i in items)}
    library = Tokenizer.from_file(queries.TOKENIZER)
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(found) == clean
    for k, r in found.items():
        ids = library.encode(texts[k], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == np.array(ids, "<u4").tobytes()
        assert r.decoded_sha256 == hashlib.sha256(texts[k].encode()).hexdigest()


def test_stages_keep_the_columns(spark):
    docs = table(spark, FOLDER, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert sorted(kept.columns) == sorted(docs.columns), name
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
