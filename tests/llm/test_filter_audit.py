"""The byte transducer and the audit of filter orders against plain counting."""

import random
import re

import pytest

from tallyspark.llm import filter_audit as f

DOCS = "doc_id long, text string, lang string, bits int, part string, n long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("chunk", [1, 7, f.CHUNK])
def test_measures(monkeypatch, chunk):
    monkeypatch.setattr(f, "CHUNK", chunk)
    draw = random.Random(chunk)
    for _ in range(400):
        text = "".join(draw.choice("ab A#\n\tü€😀\x0b\x85\xa0|$Z") for _ in range(draw.randint(0, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        capitals, symbols = len(re.findall("[A-Z]", text)), len(re.findall("[#$%&*|]", text))
        assert f.measures(text.encode()) == (len(words), len(set(words)), len(text), capitals, symbols)


def brute(docs, labels):
    """Every order applied to every row."""
    least = {}
    for doc, text, *_ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    rows = []
    for doc, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = "".join(
            letter
            for letter, fails in zip(f.FILTERS, (
                len(words) < 200, 100 * len(set(words)) < 50 * len(words),
                100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)),
                doc is not None and doc > least[text],
            ))
            if fails
        )
        said = [l for l in labels if l[0] == doc and doc is not None]
        rows.append((lang or "", failed, any(l[1] == 1 for l in said), any(l[2] == 1 for l in said)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys(f.FILTERS, 0)
        mine = [r for r in rows if r[0] == part]
        for order in f.ORDERS:
            left = mine
            for step, own in enumerate(order, 1):
                removed = [r for r in left if own in r[1]]
                gone = [r for r in mine if own in r[1] and set(order[: step - 1]) & set(r[1])]
                left = [r for r in left if own not in r[1]]
                out[part, order, step] = [
                    len(left), len(removed), len(gone), sum(r[1] == own for r in mine),
                    sum(r[2] for r in removed), sum(r[3] for r in removed),
                ]
                shapley[own] += len(removed)
        for order in f.ORDERS:
            for step, own in enumerate(order, 1):
                out[part, order, step].append(shapley[own])
    return out


def found(spark, docs, labels):
    frame = f.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = frame.collect()
    assert len({(r.part, r.filter_order, r.step) for r in rows}) == len(rows)
    return {(r.part, r.filter_order, r.step): [r[n] for n in names] for r in rows}


def test_audit_against_brute_force(spark):
    draw = random.Random(3)
    words = ["one", "Two", "#", "dreiß", "VIER", "five", "six\n"]
    texts = ["", None, "a", "A b c " * 100] + [" ".join(draw.choice(words) + str(draw.randint(0, 300)) for _ in range(n)) for n in (5, 250, 400)]
    docs = [(draw.choice([None, *range(12)]), draw.choice(texts), draw.choice(["en", "de", None, ""]), 1, "p", 2) for _ in range(80)]
    docs += docs[:5]
    labels = [(draw.choice([None, *range(14)]), draw.choice([0, 1, None]), draw.choice([0, 1])) for _ in range(20)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_part_without_failures_has_zeros(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = found(spark, [(1, text, "en", 0, "", 0)], [])
    assert len(rows) == 600 and all(v == [1, 0, 0, 0, 0, 0, 0] for v in rows.values())


def test_many_copies_and_long_text(spark):
    long = "x" * 2_000_000 + " y" * 100_000
    docs = [(k, "same text", "en", 0, "", 0) for k in range(500)] + [(1000, long, "en", 0, "", 0)]
    rows = found(spark, docs, [(k, 1, 0) for k in range(500)])
    assert rows["en", "EABCD", 1][:3] == [2, 499, 0] and rows["en", "EABCD", 1][4] == 499
    assert rows["en", "BACDE", 1][1] == 1


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
