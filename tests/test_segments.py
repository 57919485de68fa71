"""Documents cut into segments page by page, against the same cut of their joined text."""

import random
import re

import pytest

from tallyspark.operators import segments
from tallyspark.schema import PAGES

MARKER = {"claim": "** CLAIM {} **", "account": "Account # {}", "dialysis": "01/01/2024 to 01/31/2024 | 3 TREATMENTS | Claim: CLM{}"}
SIGN = {"claim": "Claim Total: x", "account": "Account Total: x", "dialysis": "PERIOD TOTAL: x"}
OPENING = {"claim": r"^[^\S\n]*\*\* CLAIM \d+ \*\*", "account": r"^[^\S\n]*Account # \d+[^\S\n]*$", "dialysis": r"^01/01/2024 to .*CLM\d+"}


def expected(pages, layout):
    """Segments and their pages from the joined text."""
    pages = sorted(pages, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""))
    text, spans = "", []
    for number, content in pages:
        spans.append((number, len(text), len(text) + len(content or "")))
        text += (content or "") + "\n"
    text = text[:-1]
    at = [m.start() for m in re.finditer(OPENING[layout], text, re.M | re.I)]
    moved = list(at)
    if layout != "dialysis":
        for k, start in enumerate(at):
            blanks = re.search(r"(?:^|(?<=\n))\s+\Z", text[:start])
            moved[k] = start - len(blanks.group()) if blanks else start
    found = []
    for k, start in enumerate(at):
        end = at[k + 1] if k + 1 < len(at) else len(text)
        low, high = moved[k], moved[k + 1] if k + 1 < len(at) else len(text)
        on = [n for n, begin, stop in spans if n is not None and begin < high and stop > low]
        shown = "" if not on else str(min(on)) if min(on) == max(on) else f"{min(on)}-{max(on)}"
        found.append((k, text[start:end], shown))
    return found


@pytest.mark.parametrize("layout", ["claim", "account", "dialysis"])
@pytest.mark.parametrize("block", [1, 4, segments.OFFSET_BLOCK])
def test_cut_like_the_joined_text(spark, monkeypatch, layout, block):
    monkeypatch.setattr(segments, "OFFSET_BLOCK", block)
    draw = random.Random(f"{layout}{block}")
    documents = {}
    for doc in range(25):
        numbers = draw.sample(range(60), draw.randint(1, 9)) + ([None] if doc % 5 == 0 else [])
        documents[f"d{doc}"] = [
            (n, "\n".join(
                draw.choice(["", "  ", "some text", "\t", MARKER[layout].format(draw.randint(1, 99)), "more of it"])
                for _ in range(draw.randint(0, 6))
            ))
            for n in numbers
        ]
        documents[f"d{doc}"].append((70, SIGN[layout]))
    rows = [(doc, n, text) for doc, pages in documents.items() for n, text in pages]
    draw.shuffle(rows)
    found = {}
    for r in segments.segments_of(spark.createDataFrame(rows, PAGES).repartition(3)).collect():
        found.setdefault(r.doc_id, []).append((r.seg, r.segment, r.page))
    for doc, pages in documents.items():
        assert sorted(found.get(doc, [])) == expected(pages, layout), (doc, pages)


def test_facts_of_documents(spark):
    rows = [
        ("a", 3, "Claim Total: x"), ("a", 1, "\n \n"), ("a", 2, "First Line Clinic\nInsurer: Late Mutual"), ("a", None, None),
        ("b", 1, "RECORDS CUSTODIAN:\nNORTH WARD, PC (Billing Records)\nAccount Total: 1"), ("b", 700, "Payer: Low Tide Plan"),
        (None, 5, "nothing known"), ("c", 1, "Inpatient Episode:"), ("c", 900, "Total Charges\nSome Insurance\nPayment"),
    ]
    found = {r.doc_id: tuple(r)[1:] for r in segments.document_facts(spark.createDataFrame(rows, PAGES), max_pages=3).collect()}
    assert found == {
        "a": (None, None, None, True),
        "b": ("account", "North Ward, PC", "Low Tide Plan", False),
        None: (None, None, None, False),
        "c": ("inpatient", "Inpatient Episode:", "Insurance Payment", False),
    }
    assert segments.segments_of(spark.createDataFrame([], PAGES)).collect() == []


def test_repeated_pages_count_each(spark):
    rows = [("d", 1, "Account # 7\nAccount Total: x")] * 2
    found = segments.segments_of(spark.createDataFrame(rows, PAGES)).orderBy("seg").collect()
    assert [(r.seg, r.page) for r in found] == [(0, "1"), (1, "1")]
