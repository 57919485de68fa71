"""Page operators, binary documents, and record rules."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.page_kinds import image_area_ratio, page_kind
from tallyspark.operators import pages as ops, rules
from tallyspark.schema import PAGES
from tallyspark.sources import files


@pytest.mark.parametrize(
    "text, kind",
    [
        ("COPY OF RECORDS PERTAINING TO: M. Arnt", "cover"),
        ("Certification of Records\nPlease complete", "certification"),
        ("Test Name Value Reference Range", "lab_report"),
        ("Billing Summary\nClaim ID 88\nClaim Total: $12.00", "billing_ledger"),
        ("PHARMACY\nRX # FILL DATE PRESCRIBER DRUG NAME NDC QTY CHARGE 3RD PARTY", "pharmacy_ledger"),
        ("Prescriber: X\nNPI: 1\nDiagnosis: J06.9", "prescription"),
        ("  \n ", "empty"),
        (None, "empty"),
        ("A letter about the weather.", "other"),
    ],
)
def test_page_kind(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(page_kind(F.col("t"))).first()[0] == kind


@pytest.fixture(scope="module")
def document(spark):
    return spark.createDataFrame(
        [("d", 1, "Billing Summary\n Claim  Total: $1.00"), ("d", 2, "Laboratory Report"), ("d", 3, " ")], PAGES
    )


def test_navigation(spark, document):
    outline = ops.outline_pages(document).orderBy("page_num").collect()
    assert [(r["kind"], r["use"]) for r in outline] == [("billing_ledger", "billing"), ("lab_report", "noise"), ("empty", "noise")]
    assert outline[0]["snippet"] == "Billing Summary Claim Total: $1.00"
    assert [r["page_num"] for r in ops.search_pages(document, " laboratory ").collect()] == [2]
    assert ops.search_pages(document, "  ").count() == 0
    asked = spark.createDataFrame([("d", [3, 99, 1, 3])], "doc_id string, page_nums array<int>")
    found = ops.read_pages(asked, document).orderBy("pos").collect()
    assert [(r["page_num"], r["status"]) for r in found] == [(3, "blank"), (99, "missing"), (1, "text"), (3, "blank")]


def test_offsets_of_a_long_document(spark):
    frame = spark.createDataFrame([("d", i, "x" * (i % 7)) for i in range(1, 1001)], PAGES)
    found = ops.page_offsets(frame).orderBy("page_num").collect()
    at = 0
    for number, row in enumerate(found, 1):
        assert (row["start"], row["end"]) == (at, at + number % 7)
        at += number % 7 + 1


def test_routes(spark):
    rows = [
        ("scan", 1, "", 1, 0.9), ("scan", 2, None, 1, 0.9),
        ("mixed", 1, "a page with enough text on it", 0, 0.0), ("mixed", 2, "Total", 1, 0.1),
        ("wide", 1, "a page with enough text on it and an image", 1, 0.675),
        ("text", 1, " ", 0, 0.0), ("text", 2, "a page with enough text on it", 2, 0.1),
    ] + [("long", i, "x", 0, 0.0) for i in range(1, 6)]
    frame = spark.createDataFrame(rows, PAGES + ", n_images int, image_area_ratio double")
    found = {r["doc_id"]: (r["route"], r["visual_pages"]) for r in ops.route_documents(frame, max_pages=4).collect()}
    assert found == {
        "scan": ("visual", [1, 2]), "mixed": ("visual", [2]), "wide": ("visual", [1]), "text": ("text", []),
        "long": ("reject_too_long", []),
    }
    image = spark.sql("SELECT array(named_struct('x0', 0D, 'x1', 540D, 'top', 0D, 'bottom', 600D)) AS i")
    assert image.select(image_area_ratio(F.col("i"), F.lit(600.0), F.lit(800.0))).first()[0] == pytest.approx(0.675)


def test_binary_documents(spark, tmp_path):
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    (tmp_path / "c.pdf").write_bytes(b"")
    (tmp_path / "d.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    (tmp_path / "e.txt").write_bytes(b"%PDF-")
    found = files.read_binary_documents(spark, str(tmp_path))
    states = {r["path"].rsplit("/", 1)[1]: r for r in files.admit_documents(found, max_bytes=50).collect()}
    assert {k: r["state"] for k, r in states.items()} == {
        "a.pdf": "accepted", "b.pdf": "not_pdf", "d.pdf": "too_large",
    }
    assert len(states["a.pdf"]["content_hash"]) == 64 and states["b.pdf"]["content_hash"] is None
    nothing = spark.createDataFrame([(bytearray(), 0)], "content binary, length bigint")
    assert nothing.select(files.admission_state(F.col("content"), F.col("length"))).first()[0] == "empty"
    later = F.lit((datetime.datetime.now() + datetime.timedelta(days=31)).isoformat()).cast("timestamp")
    assert files.expired_files(found, later, 30).count() == 3
    assert files.expired_files(found, later, 40).count() == 0
    assert files.expired_files(found, later, 0).count() == 0


def test_rules(spark):
    money = lambda *v: tuple(None if x is None else Decimal(x) for x in v)
    frame = spark.createDataFrame(
        [money(1, 1, 1, 1, 1), money(1, 1, 1, None, 1), money(1, None, None, 1, 1), money(1, None, None, None, None), money(None, 1, 1, 1, 1)],
        "total_charges decimal(18,2), ins_paid decimal(18,2), adjustment decimal(18,2), payments decimal(18,2), balance decimal(18,2)",
    )
    assert [r["severity"] for r in rules.with_review_severity(frame).collect()] == [None, "low", "medium", "high", "high"]
    words = spark.createDataFrame([(" N/A ",), ("unknown",), ("",), ("Acme",)], "w string")
    assert [r[0] for r in words.select(rules.no_placeholder(F.col("w"))).collect()] == [None, None, None, "Acme"]
