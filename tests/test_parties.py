"""Third-party names as relations, against the same reading of whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import parties as whole
from tallyspark.operators import parties
from tallyspark.schema import PAGES

FILLS = [
    "03/14/2022 4410273 Ramipril 5mg 40118-0932-75 STRAND OLE 56 28 $12.40 Corner Discount (BIN 550071)",
    "03/15/2022 4410274 Nasal spray 10 mg 40118-0932-76 MOEN ADA 30 30 $8.15 CAREX (BIN 1)",
    "03/16/2022 4410275 Ramipril 5mg 40118-0932-75 STRAND OLE 56 28 $12.40",
    "03/17/2022 4410276 Zinc 40118-0932-77 Delta PBM LUNDE KIM 30 15 $3.00 $1.00",
    "03/18/2022 4410277 Zinc 40118-0932-77",
]
LINES = FILLS + [
    "", "  ", "Delta PBM", "delta pbm", "Sun Saver Card", "Sun Saver", "Saver (BIN 77)", "STRAND", "Ramipril", "(BIN 9)", "Page 3",
    "Harbor Health", "Harbor Health Plan (BIN 4)", "HARBOR", "O'Dell (BIN 5)", "O'Dell-West Group (BIN 5)", "TOTALS: $9.00",
    "One two three four five six (BIN 2)", "Date Rx # Drug", "Total fills: 3", "Payment Summary", "Rx # Date Drug", "(bin 3) refill",
    "Drug NDC 3rd Party Prescriber Qty", "ab\r\ncd", "*** END OF PATIENT PROFILE", "Moon Plan  (BIN 12345) $4.00",
]


def expected(spark, documents):
    rows = []
    for doc, pages in documents.items():
        ordered = sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
        rows.append((doc, "\n".join(text or "" for _, text in ordered)))
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    listed = frame.select("doc_id", whole.third_parties(F.col("text"), whole.billing_section(F.col("text"))).alias("names"))
    return {r.doc_id: r.names for r in listed.collect() if r.names}


def found(frame):
    names = {}
    for r in sorted(frame.collect(), key=lambda r: r["first"]):
        names.setdefault(r["doc_id"], []).append(r["name"])
    return names


def shuffled(spark, documents):
    rows = [(doc, number, text) for doc, pages in documents.items() for number, text in pages]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.mark.parametrize("block", [4, parties.LINE_BLOCK])
def test_names_like_in_the_whole_text(spark, monkeypatch, block):
    monkeypatch.setattr(parties, "LINE_BLOCK", block)
    monkeypatch.setattr(parties, "PAGE_BLOCK", block)
    draw = random.Random(block)
    documents = {}
    for doc in range(60):
        pages = []
        for number in draw.sample(range(30), draw.randint(1, 6)) + ([None] if doc % 6 == 0 else []):
            text = "\n".join(draw.choice(FILLS if draw.random() < 0.4 else LINES) for _ in range(draw.randint(0, 9)))
            pages.append((number, None if draw.random() < 0.05 else text))
        if doc % 5 == 1:
            pages.append((31, "Third-Party Payer Detail\nPayer BIN Paid\nMoon Rx BIN 44 $5.00\nmoon rx $1\nStar Health $2.00\nGrand Total $9.00"))
        if doc % 3 == 0:
            pages.append((40, "\n".join(FILLS[:2] * 30 + ["Rare Plan (BIN 6)"])))
        documents[f"d{doc}" if doc else None] = pages
    assert found(parties.third_parties(shuffled(spark, documents))) == expected(spark, documents)


def test_nothing_to_read(spark):
    assert parties.third_parties(spark.createDataFrame([], PAGES)).collect() == []
    assert parties.third_parties(spark.createDataFrame([(None, None, None), ("a", 1, "")], PAGES)).collect() == []


def test_fragments(spark):
    listed = {
        "a": ["Sun", "Sun Saver", "Sunny Day", "Blue Health", "Blue Health Plan", "Green Health", "x.", "x.y", "Blue"],
        "b": ["Sun", "Third Party", "Third Party Payer", "third party payer", "O'Dell", "O'Dell-West", "west"],
        None: ["Sun", "Big Sun"],
    }
    rows = [(doc, name) for doc, names in listed.items() for name in names]
    kept = parties.without_fragments(spark.createDataFrame(rows, "doc_id string, name string")).collect()
    text = spark.createDataFrame([(d, n) for d, n in listed.items()], "doc_id string, names array<string>")
    compact = text.select("doc_id", F.explode(whole._compact(F.col("names"))).alias("name")).collect()
    assert sorted((r.doc_id or "", r.name) for r in kept) == sorted((r.doc_id or "", r.name) for r in compact)
    assert ("a", "Blue") not in {(r.doc_id, r.name) for r in kept} and ("a", "Green Health") in {(r.doc_id, r.name) for r in kept}


def test_fragments_among_many_names(spark):
    numbered = spark.range(10_000).select(F.lit("d").alias("doc_id"), F.concat(F.lit("Plan w"), "id", F.lit(" Fund")).alias("name"))
    single = spark.range(10_000).select(F.lit("d").alias("doc_id"), F.concat(F.lit("W"), F.col("id") * 2).alias("name"))
    kept = parties.without_fragments(numbered.unionByName(single))
    assert kept.count() == 15_000


def test_repeated_names_are_looked_into_once(spark, monkeypatch):
    looked, kept = {}, parties.stored

    def keep(df, label):
        done = kept(df, label)
        looked[label] = looked.get(label, 0) + done.count()
        return done

    monkeypatch.setattr(parties, "stored", keep)
    fills = [FILLS[0].replace("4410273", f"44{k:05}") for k in range(300)]
    cells = [f"44{k:05} 03/17/2022 Zinc 40118-0932-77 Delta PBM LUNDE KIM 30 15 $3.00 $1.00" for k in range(300)]
    beside = ["Sun\n4500001 03/17/2022 Zinc 40118-0932-77 LUNDE KIM 30 15 $3.00 $1.00\nSaver Card"] * 20
    head = "Rx # Date Drug NDC 3rd Party\nPrescriber Qty"
    documents = {"bin": [(1, "Date Rx #"), (2, "\n".join(fills))], "column": [(1, head), (2, "\n".join(cells + beside))]}
    names = found(parties.third_parties(shuffled(spark, documents)))
    assert names == expected(spark, documents) == {"bin": ["Corner Discount"], "column": ["Delta PBM", "Sun Saver Card"]}
    # a row for each different list of words or cell, not for each word of each fill
    assert looked["party-words"] < 20 and looked["party-cells"] == 2


def test_headings_in_other_letters(spark):
    detail = "Moon Rx BIN 44 $5.00\nSun Rx $1.00\n{}\nLate Rx $2.00"
    starts = ["Third-Party Payer Detail", "THIRD PARTY PAYER DETAIL", "Thırd party payer detaİl"]
    stops = ["Payment Summary", "payment ſummary", "GRAND TOTAL", "Page 7", "pages", "Payment"]
    documents = {f"{i}{j}": [(1, f"{a}\n{detail.format(b)}")] for i, a in enumerate(starts) for j, b in enumerate(stops)}
    names = found(parties.third_parties(shuffled(spark, documents)))
    assert names["10"] == ["Moon Rx", "Sun Rx"] and names["04"] == ["Moon Rx", "Sun Rx", "Late Rx"]
    assert names["21"] == names["10"] and names["23"] == names["10"] and names["25"] == names["04"]
