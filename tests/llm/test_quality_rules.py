"""Base counts and histogram distances against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import quality_rules as q

DOCS = "doc_id long, text string, lang string, n_words string, word string, n long"


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)
    )


def test_measure():
    draw = random.Random(2)
    for _ in range(500):
        text = "".join(draw.choice("ab  A#\n\n\tü€😀\x0b\x85\xa0|<") for _ in range(draw.randint(0, 60)))
        assert q.measure(text.encode())[:5] == counts(text)


def test_repeats_with_many_distinct_words():
    ids = np.array([5, 1 << 22, 7, 5, 1 << 22, 7, 9])
    assert q.repeated_words(ids, (1 << 22) + 1) == 6


@pytest.mark.parametrize(("p", "expected"), [([1, 0], 1.0), ([0, 4], 0.0), ([2, 2], math.sqrt(0.3112781244591328))])
def test_distance(p, expected):
    assert q.jensen_shannon(np.array(p, float), np.array([0.0, 9.0])) == pytest.approx(expected)


def prose(draw, n):
    common = "the of and to in is that it for was".split()
    words = [draw.choice(common) if draw.random() < 0.5 else "".join(draw.choice("abcdefghilmnorst") for _ in range(6)) for _ in range(n)]
    return ". ".join(" ".join(words[k : k + 12]).capitalize() for k in range(0, n, 12)) + "."


def test_verdicts(spark):
    draw = random.Random(8)
    good = [(k, prose(draw, draw.randint(60, 400)), "en", "", "", 0) for k in range(200)]
    bad = [
        (900, " ".join(f"LOUD{k}!!" for k in range(200)), "en", "", "", 0),
        (901, " ".join(f"{draw.randint(0, 10**6)}" for _ in range(300)), "en", "", "", 0),
        (902, "one two three four " * 60, "en", "", "", 0),
        (903, "too short", "en", "", "", 0),
        (904, None, None, "", "", 0),
        (905, "", "en", "", "", 0),
    ]
    alone = [(950, "zzz " + " ".join(f"q{k}" for k in range(80)), "zu", "", "", 0)]
    found = {r.doc_id: r for r in q.judged(spark.createDataFrame(good + bad + alone, DOCS)).collect()}
    assert all(found[k].kept for k in range(200))
    assert not any(found[k].kept for k in range(900, 906))
    assert [found[k].base_failed for k in range(900, 906)] == [False, False, True, True, True, True]
    assert found[950].kept and found[950].word_distance is None  # too few words for a reference: not compared
    for doc, text, *_ in good + bad:
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(text or "")


def test_references_are_counts_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(q, "HELD", 10)
    draw = random.Random(4)
    docs = [(k, prose(draw, 100), draw.choice(["en", "de", "xx-no-code", None]), "", "", 0) for k in range(60)]
    refs = q.references(spark.createDataFrame(docs, DOCS).repartition(5))
    assert set(refs) == {"en", "de", "und"}
    for lang, ref in refs.items():
        texts = [t for _, t, l, *_ in docs if (l if l in ("en", "de") else "und") == lang]
        words = Counter(w.lower().strip(".,;:!?\"'()") for t in texts for w in t.split())
        top = sorted(words.items(), key=lambda x: (-x[1], x[0].encode()))[: q.COMMON]
        assert [w.decode() for w in ref.places] == [w for w, _ in top]
        assert ref.words.tolist() == [n for _, n in top] + [words.total() - sum(n for _, n in top)]
        assert ref.classes.sum() == sum(map(len, texts))


def test_odd_rows_and_empty_table(spark):
    rows = [(1, "word " * 400_000, "en", "", "", 0)] * 2 + [(None, "\x00 ü", "??", "", "", 0)]
    found = q.judged(spark.createDataFrame(rows, DOCS)).collect()
    assert [r.n_repeat_words for r in found if r.doc_id == 1] == [400_000] * 2
    assert len(found) == 3 and not any(r.kept for r in found)
    assert q.judged(spark.createDataFrame([], DOCS)).collect() == []
