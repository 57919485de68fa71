"""Benchmark overlaps against a comparison of all alignments."""

import itertools
import random
import re

from tallyspark.llm import decontamination
from tallyspark.llm.decontamination import LEAST_EQUAL, OVERLAP, SEEDS

DICE = random.Random(6)
WORDS = [f"w{k}é" for k in range(4000)]


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def passage(n):
    return [DICE.choice(WORDS) for _ in range(n)]


def overlaps(doc, item):
    """Whether 12 of 14 aligned tokens are equal, with a seed that hits among them."""
    for shift in range(-len(item), len(doc)):
        same = [0 <= shift + j < len(doc) and doc[shift + j] == w for j, w in enumerate(item)]
        for at in range(len(item)):
            for seed in SEEDS:
                if at + len(seed) > len(item) or not all(same[at + k] for k, m in enumerate(seed) if m == "1"):
                    continue
                for first in range(at - (OVERLAP - min(map(len, SEEDS))), at + 1):
                    if sum(same[max(0, first) : first + OVERLAP]) >= LEAST_EQUAL:
                        return True
    return False


def tables(spark, docs, items):
    kinds = "text string, hash string, words int"
    return (
        spark.createDataFrame([(k, t, "x", 1) for k, t in docs], f"doc_id long, {kinds}"),
        spark.createDataFrame([(k, t, "x", 1) for k, t in items], f"item_id long, {kinds}"),
    )


def test_overlaps_match_brute_force(spark):
    items = [(k, " ".join(passage(n))) for k, n in enumerate([13, 14, 20, 40, 60])]
    items += [(50, items[3][1].upper() + "!"), (51, None), (52, "")]
    docs = [(None, items[3][1]), (0, None), (1, ""), (2, " ".join(passage(5)))]
    for n in range(60):
        item = tokens(items[n % 5][1])
        first = DICE.randrange(len(item) - 10)
        part = item[first : first + DICE.randint(10, 40)]
        for _ in range(DICE.randint(0, 5)):
            part[DICE.randrange(len(part))] = DICE.choice(WORDS)
        docs.append((10 + n, "### ".join(passage(DICE.randint(0, 30)) + part + passage(DICE.randint(0, 30)))))
    docs.append((10, docs[4][1]))
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(*tables(spark, docs, items)).collect()}
    want = {
        (d, i) for d, text in docs for i, item in items[:5] if len(tokens(item)) >= OVERLAP and overlaps(tokens(text), tokens(item))
    }
    assert found == want
    assert len(want) > 15


def test_substitutions_are_tolerated(spark):
    item = passage(45)
    changed = [DICE.choice(WORDS) if k % 8 == 3 else w for k, w in enumerate(item)]
    docs, items = tables(spark, [(1, " ".join(passage(50) + changed + passage(50))), (2, " ".join(passage(80)))], [(7, " ".join(item))])
    assert [(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()] == [(1, 7)]
    kept = decontamination.without_benchmark(docs, items)
    assert [r.doc_id for r in kept.collect()] == [2] and set(kept.columns) == set(docs.columns)


def test_blocks_and_long_items_change_nothing(spark, monkeypatch):
    items = [(k, " ".join(passage(200))) for k in range(6)]
    docs = [(k, " ".join(tokens(items[k % 6][1])[20 * k : 20 * k + 30])) for k in range(9)]
    frames = tables(spark, docs, items)
    want = sorted(map(tuple, decontamination.contaminated(*frames).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 500)
    monkeypatch.setattr(decontamination, "PIECE", 25)
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(*frames).collect()) == [w[:2] for w in want]
    assert len(want) == 9


def test_empty_tables(spark):
    docs, items = tables(spark, [(1, " ".join(passage(30)))], [(1, " ".join(passage(30)))])
    assert decontamination.contaminated(docs.limit(0), items).collect() == []
    assert decontamination.contaminated(docs, items.limit(0)).collect() == []
    assert decontamination.without_benchmark(docs, items.limit(0)).count() == 1


def test_seeds_fit_any_two_substitutions():
    places = [
        {at + k for k, mark in enumerate(seed) if mark == "1"} for seed in SEEDS for at in range(OVERLAP - len(seed) + 1)
    ]
    assert all(len(seed) <= OVERLAP and seed.count("1") == 8 for seed in SEEDS)
    for changed in itertools.combinations(range(OVERLAP), OVERLAP - LEAST_EQUAL):
        assert any(not held & set(changed) for held in places), changed


def test_overlaps_match_the_plain_rule(spark):
    def plain(doc, item):
        for shift in range(-len(item), len(doc)):
            same = [0 <= shift + j < len(doc) and doc[shift + j] == w for j, w in enumerate(item)]
            if any(sum(same[max(0, first) : first + OVERLAP]) >= LEAST_EQUAL for first in range(1 - OVERLAP, len(item))):
                return True
        return False

    items = [(n, passage(n)) for n in (14, 15, 16, 17, 30)]
    docs = []
    for n, item in items[:4]:
        for changed in itertools.combinations(range(n), 2 if n == 14 else 3):
            part = [f"x{DICE.randrange(1000)}" if k in changed else w for k, w in enumerate(item)]
            docs.append((len(docs), passage(3) + part + passage(3)))
    for _ in range(40):
        first = DICE.randrange(25)
        docs.append((len(docs), passage(2) + items[4][1][first : first + DICE.randint(10, 16)] + passage(2)))
    frames = tables(spark, [(k, " ".join(d)) for k, d in docs], [(k, " ".join(i)) for k, i in items])
    found = {(r.doc_id, r.item_id) for r in decontamination.contaminated(*frames).collect()}
    assert found == {(k, i) for k, doc in docs for i, item in items if set(doc) & set(item) and plain(doc, item)}


def test_short_items_are_found_whole(spark):
    items = [(n, passage(n)) for n in range(1, 14)]
    held = [(n, passage(20) + item + passage(n % 3)) for n, item in items]
    broken = [(100 + n, passage(20) + item[: n // 2] + ["zz"] + item[n // 2 + 1 :]) for n, item in items]
    docs = held + broken + [(200, items[12][1]), (201, items[12][1][:-1])]
    within = lambda doc, item: any(doc[k : k + len(item)] == item for k in range(len(doc)))
    frames = tables(spark, [(k, " ".join(d)) for k, d in docs], [(k, " ".join(i)) for k, i in items])
    found = {(r.doc_id, r.item_id): r.equal_tokens for r in decontamination.contaminated(*frames).collect()}
    assert found == {(k, n): n for k, doc in docs for n, item in items if within(doc, item)}
    assert set(found) >= {(n, n) for n in range(1, 14)} | {(200, 13)}


def test_rows_go_by_their_own_text(spark):
    item = " ".join(passage(30))
    clean = [" ".join(passage(30)) for _ in range(3)]
    docs, items = tables(spark, [(None, item), (None, clean[0]), (5, item), (5, clean[1]), (6, item), (6, item), (7, clean[2]), (8, None)], [(1, item)])
    kept = decontamination.without_benchmark(docs, items)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(None, clean[0]), (5, clean[1]), (7, clean[2]), (8, None)}
