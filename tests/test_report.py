"""Report rows, filters, facets, totals and invoice groups on small job tables."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.dates import treatment_span
from tallyspark.functions.money import usd
from tallyspark.functions.text import file_name
from tallyspark.operators.report import (
    ReportFilters, filter_report, flatten_report, invoice_groups, job_cards, job_totals, report_facets, report_page,
    report_totals,
)
from tallyspark.schema import JOBS, RECORD_FIELDS

BASE = dict(
    invoice_number="BILL-7", treatment_date="01/01/2026", cpt_codes=["90832"], description="Therapy hour",
    provider="Aster Clinic", insurers=["Ember Health"], third_parties=[], total_charges=Decimal(100),
    ins_paid=Decimal(60), adjustment=Decimal(20), payments=Decimal(5), balance=Decimal(15), page="1",
)


def record(**changes):
    row = {**BASE, **changes}
    return tuple(row[f] for f in RECORD_FIELDS)


def flag(row=0, reason="Total looks off"):
    return (row, ["balance"], reason, "1", "medium")


def job(job_id, records=(), flagged=(), status="completed", path="/app/pdfs/user/source-a.pdf", duration=1.0):
    result = (list(records), list(flagged))
    return (job_id, "u", "f.pdf", path, status, None, result, None, None, None, duration, 0, None, None, None, None)


def rows(spark, *jobs):
    return flatten_report(spark.createDataFrame(list(jobs), JOBS))


def ids(frame):
    return sorted(r["row_id"] for r in frame.collect())


def test_only_records_of_completed_jobs(spark):
    found = rows(
        spark, job("job-1", [record()]), job("p", [record()], status="pending"),
        job("f", [record()], status="failed"), job("e"),
    ).collect()
    assert [(r["row_id"], r["source_file"]) for r in found] == [("job-1:0", "source-a.pdf")]


def test_row_and_document_flags(spark):
    found = rows(
        spark,
        job("a", [record(), record()], [flag(1), flag(5)]),
        job("b", [record()], [flag(0, "row"), flag(None, "document")]),
    ).orderBy("row_id").collect()
    assert [r["needs_review"] for r in found] == [False, True, True]
    assert found[2]["review_reasons"] == ["document", "row"]


@pytest.fixture(scope="module")
def table(spark):
    return rows(
        spark,
        job(
            "a",
            [
                record(),
                record(invoice_number="  ", provider="Beta Lab", balance=Decimal(0), insurers=["River", ""],
                       third_parties=["Moon Rx", "River"], treatment_date="01/10/2026 – 02/15/2026"),
                record(invoice_number=None, balance=None, total_charges=Decimal(0), treatment_date="Various",
                       description=None),
            ],
            [flag(1)],
        ),
        job("b", [record(treatment_date="2026-06-03", cpt_codes=["A1234", "90832,25"])]),
    ).cache()


@pytest.mark.parametrize(
    "filters, expected",
    [
        (dict(), ["a:0", "a:1", "a:2", "b:0"]),
        (dict(query="  BETA "), ["a:1"]),
        (dict(query="invoice not found"), ["a:1", "a:2"]),
        (dict(query="a1234 90832,25"), ["b:0"]),
        (dict(query="100%"), []),
        (dict(provider="Beta Lab"), ["a:1"]),
        (dict(invoice="__missing_invoice__"), ["a:1", "a:2"]),
        (dict(payer="Moon Rx"), ["a:1"]),
        (dict(review="needs_review"), ["a:1"]),
        (dict(review="clean"), ["a:0", "a:2", "b:0"]),
        (dict(financial="has_balance"), ["a:0", "b:0"]),
        (dict(financial="has_charges"), ["a:0", "a:1", "b:0"]),
        (dict(date_from="2026-02-01", date_to="2026-02-28"), ["a:1"]),
        (dict(date_to="2030-01-01"), ["a:0", "a:1", "b:0"]),
    ],
)
def test_filters(table, filters, expected):
    assert ids(filter_report(table, ReportFilters(**filters))) == expected


def test_totals_count_missing_as_zero(spark):
    found = rows(
        spark, job("a", [record(), record(ins_paid=None, total_charges=Decimal(200), payments=Decimal(25), balance=Decimal(0), adjustment=Decimal(10))])
    )
    total = report_totals(found).first()
    assert [float(v) for v in total] == [2, 300, 60, 30, 30, 15]
    none = report_totals(found.where("false")).first()
    assert [float(v) for v in none] == [0, 0, 0, 0, 0, 0]
    assert job_totals(rows(spark, job("a", [record(balance=None)]))).first()["balance"] is None


def test_facets_are_distinct_and_ordered(spark):
    found = rows(
        spark,
        job("a", [record(provider=p, invoice_number=i) for p, i in [("b", None), ("A", "INV-2"), ("a", "INV-2"), ("B", "Z")]]),
    )
    facets = report_facets(found).collect()
    assert [r["value"] for r in facets if r["facet"] == "provider"] == ["a", "A", "b", "B"]
    assert [r["label"] for r in facets if r["facet"] == "invoice"] == ["INV-2", "Invoice not found", "Z"]


def test_invoice_groups_in_first_seen_order(spark):
    names = ["INV-200", "BILL-7", "INV-200", None, "   "]
    found = invoice_groups(rows(spark, job("a", [record(invoice_number=n) for n in names]))).orderBy("group_no").collect()
    assert [(r["label"], r["record_idx"]) for r in found] == [
        ("Invoice INV-200", [0, 2]), ("Invoice BILL-7", [1]), ("Invoice not found", [3, 4]),
    ]


def test_page_number_is_kept_in_range(table):
    found = report_page(table, 99, page_rows=3).collect()
    assert [(r["row_id"], r["page_no"], r["page_count"]) for r in found] == [("b:0", 2, 2)]
    assert report_page(table.where("false"), 5).count() == 0


def test_cards(spark):
    frame = spark.createDataFrame([job("a", [record(), record(invoice_number=None)], [flag()], duration=0.0)], JOBS)
    card = job_cards(frame).first()
    assert (card["records"], card["invoices"], card["flagged"], card["cached"], card["live"]) == (2, 2, 1, True, False)


@pytest.mark.parametrize(
    "text, start, end",
    [
        ("2017-03-16", "2017-03-16", "2017-03-16"),
        ("3/6/2017", "2017-03-06", "2017-03-06"),
        ("3-16-17", "2017-03-16", "2017-03-16"),
        ("3-16-70", "1970-03-16", "1970-03-16"),
        ("03/16/2017 – 03/20/2017", "2017-03-16", "2017-03-20"),
        ("03/20/2017 to 03/16/2017", "2017-03-20", "2017-03-16"),
        ("13/45/2017 then 01/02/2018", "2018-01-02", "2018-01-02"),
        ("Invoice 88-77-6655", None, None),
        ("02/30/2018", None, None),
        ("2020-99-99", None, None),
        ("Various", None, None),
        (None, None, None),
    ],
)
def test_treatment_span(spark, text, start, end):
    frame = spark.createDataFrame([(text,)], "t string").select(treatment_span(F.col("t")).alias("s")).select("s.*")
    assert tuple(None if v is None else str(v) for v in frame.first()) == (start, end)


def test_money_and_file_names(spark):
    frame = spark.createDataFrame([(1850.0, "/a/b.pdf"), (None, "b.pdf"), (-5.0, "a/"), (0.0, "")], "m double, p string")
    found = frame.select(usd(F.col("m")), file_name(F.col("p"))).collect()
    assert [tuple(r) for r in found] == [("$1,850.00", "b.pdf"), ("—", "b.pdf"), ("-$5.00", "a/"), ("$0.00", "")]
