"""Work that must not gather a document in one task, nor cross an exchange twice."""

import re

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import evaluation, extraction, jobs, parties, report
from tallyspark.schema import JOBS, PAGES
from tallyspark.session import stored
from tallyspark.sources import warehouse

LINE = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    rows = spark.range(200).select(
        F.expr("id div 3").alias("l_orderkey"), (F.col("id") % 7).alias("l_partkey"), (F.col("id") % 5).alias("l_suppkey"),
        (F.col("id") % 3 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50).cast("double").alias("l_quantity"),
        (F.col("id") * 3.25).alias("l_extendedprice"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"),
        F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus"),
        F.lit("1995-03-04").cast("timestamp").alias("l_shipdate"),
    )
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def claims(spark, payers):
    text = "\n".join(
        f"** CLAIM {i} **\nItem 1 / {payer}\n{i} 99213 01/02/2024 CHARGE X $9.00\nClaim Total: $9.00 $4.00 $1.00 $4.00"
        for i, payer in enumerate(payers, 100001)
    )
    return spark.createDataFrame([("a", 1, "Copies"), ("a", 2, text), (None, 1, text)], PAGES)


def test_records_are_numbered_in_blocks(spark, monkeypatch):
    payers = ["Quartz Meadow Plan", "Granite Mutual", "Quartz Meadow Health", "Quartz Meadow Health", "Granite Life"] * 2
    whole = extraction.extract_records(claims(spark, payers))
    # no window goes over the records of a whole document
    assert not re.search(r"windowspecdefinition\((doc_id|_doc)#\d+, seg#", plan(whole))
    monkeypatch.setattr(extraction, "RECORD_BLOCK", 2)
    blocks = extraction.extract_records(claims(spark, payers))
    rows = lambda df: sorted((str(r["doc_id"]), r["idx"], r["invoice_number"], r["insurers"][0]) for r in df.collect())
    assert rows(blocks) == rows(whole)
    settled = [p.replace("Meadow Plan", "Meadow Health") for p in payers]
    assert rows(blocks) == sorted(
        (doc, i, f"Claim {i + 100001}", p) for doc in ("a", "None") for i, p in enumerate(settled)
    )


def test_lines_of_documents_are_numbered_once(spark, monkeypatch):
    seen = {}

    def keep(df, label):
        seen[label] = plan(df)
        return stored(df, label)

    monkeypatch.setattr(parties, "stored", keep)
    pages = spark.createDataFrame([("a", 1, "Date Rx #\nMoon Plan (BIN 1)\nPayment Summary")], PAGES)
    assert [r["name"] for r in parties.third_parties(pages).collect()] == ["Moon Plan"]
    assert "Window" in seen["lines"] and "Window" not in seen["party-details"]


def test_printed_documents_cross_one_exchange(spark, folder):
    pages = warehouse.ledger_pages(spark, folder, "claim")
    assert plan(pages).count("Exchange") == 1
    assert pages.select("doc_id").distinct().count() == 9
    assert pages.where(F.col("page_content").contains("CLAIM TOTAL")).count() > 0


def test_truth_and_predictions_meet_without_another_exchange(spark, folder):
    truth = warehouse.ground_truth(spark, folder).select("doc_id", "records")
    paired = evaluation.paired_records(truth, warehouse.predictions(spark, folder))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert plan(paired).count("Exchange") == 2
        assert paired.count() == 67
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_values_of_lines_are_derived_after_their_exchange(spark, folder):
    for dealt, rows in [(None, 200), (warehouse.ledger_document(), 200)]:
        lines = warehouse.order_lines(spark, folder, dealt)
        above, below = plan(lines).split("Exchange")
        assert "gross" in above and "gross" not in below and "first_ship" not in below
        assert lines.count() == rows


def test_report_rows_are_made_once(spark):
    rows = spark.range(30).select(
        F.explode(F.sequence(F.lit(0), F.lit(3))).alias("idx"), F.concat(F.lit("job-"), "id").alias("job_id")
    )
    page = report.report_page(rows, 3, 50)
    assert "Range (" not in plan(page) and "Generate" not in plan(page)
    every = sorted((f"job-{i}", n) for i in range(30) for n in range(4))
    assert [(r.job_id, r.idx) for r in page.orderBy("row_no").collect()] == every[100:]


def test_results_are_needed_for_copied_jobs_only(spark):
    decisions = spark.createDataFrame(
        [("r1", "u", "h", "cached", "a"), ("r2", "u", "h", "cached", "a"), ("r3", "u", "g", "created", "r3"), ("r4", "u", "g", "joined", "b")],
        "request_id string, owner_id string, content_hash string, outcome string, target_id string",
    )
    requests = decisions.select("request_id", "owner_id", "content_hash", F.lit("f").alias("pdf_filename"), F.lit("p").alias("pdf_path"))
    row = lambda job_id: (job_id, "u", "f", f"/{job_id}", "completed", "h", ([], []), None, None, 0.5, *[None] * 6)
    table = spark.createDataFrame([row("a"), row("a"), row("b"), row(None), row("c")], JOBS)
    copied = jobs.copied_jobs(decisions, table)
    assert [r.id for r in copied.collect()] == ["a", "a"] and copied.schema == table.schema
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    new = [sorted(jobs.jobs_from_submissions(requests, decisions, t, now).collect(), key=str) for t in (table, copied)]
    assert new[0] == new[1] and [r.id for r in new[0]] == ["r1", "r1", "r2", "r2", "r3"]


def test_plain_words_share_one_index_without_names(spark):
    listed = [("a", n) for n in ["Sun", "Sun Saver", "Sun Day", "O'Dell", "O'Dell-West Plan", "West", "Blue Health", "Blue Health Fund", "Blue X Fund", "été", "Grand Été"]]
    listed += [(None, "Sun"), (None, "sun"), ("", "Sun Saver"), ("b", "-"), ("b", "x-y Plan"), ("b", "x - y"), ("b", "Y"), ("c", ""), ("c", "a  b")]
    names = spark.createDataFrame(listed, "doc_id string, name string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = parties.without_fragments(names)
        index = re.search(r"keys=\[(_doc#\d+, _none#\d+, _word#\d+)\]", plan(kept))
        assert index and plan(kept).count("Exchange") == 4
        left = {(r.doc_id, r.name) for r in kept.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    gone = {("a", "Sun"), ("a", "O'Dell"), ("a", "West"), ("a", "Blue Health"), ("a", "été"), ("b", "-"), ("b", "Y")}
    assert left == set(listed) - gone
