"""Learned-partition search: recall against brute force, exact scores, ties and unusable vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import ann

KIND = "vec_id long, embedding array<float>, part string, vector int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], KIND)


def brute_force(ids, x, asks, k):
    out = {}
    for a in np.flatnonzero(asks):
        scores = (x * x[a]).sum(axis=1)
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[a]), key=lambda j: (-scores[j], ids[j]))
        out[ids[a]] = [(ids[j], scores[j]) for j in order[:k]]
    return out


@pytest.fixture(scope="module")
def clustered():
    dice = np.random.default_rng(4)
    centres = dice.standard_normal((12, 24))
    return (centres[dice.integers(0, 12, 1500)] + 0.6 * dice.standard_normal((1500, 24))).astype(np.float32)


def test_recall_scores_and_order(spark, clustered, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 60)  # many blocks of rows and of queries
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    x, ids = clustered.astype(np.float64), np.arange(1500)
    rows = ann.search(frame(spark, [(int(i), v.tolist()) for i, v in enumerate(clustered)]), F.col("vec_id") % 20 == 0).collect()
    want = brute_force(ids, x, ids % 20 == 0, 20)
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(want)
    hits = 0
    for query, best in found.items():
        assert [r.rank for r in best] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in best] == sorted((-r.score, r.vec_id) for r in best)
        assert all(r.score == pytest.approx(float(x[query] @ x[r.vec_id]), rel=1e-12, abs=1e-12) for r in best)
        hits += len({r.vec_id for r in best} & {i for i, _ in want[query]})
    assert hits >= 0.9 * 20 * len(want)


def test_ties_go_to_the_smaller_id(spark):
    dice = np.random.default_rng(1)
    same = dice.standard_normal(8).astype(np.float32).tolist()
    rows = [(i, same) for i in range(60)] + [(100 + i, (0.1 * dice.standard_normal(8)).tolist()) for i in range(40)]
    found = ann.search(frame(spark, rows + rows[:5]), F.col("vec_id") == 7).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [i for i in range(21) if i != 7]
    assert len({r.score for r in found}) == 1


def test_unusable_vectors_take_no_part(spark):
    bad = [(90, None), (91, [0.0, 0.0]), (92, [1.0, None]), (93, [float("nan"), 1.0]), (94, [float("inf"), 1.0]), (95, []),
           (None, [1.0, 1.0]), (96, [1.0, 2.0, 3.0])]
    good = [(k, [1.0 + k, 2.0 - k]) for k in range(5)]
    found = ann.search(frame(spark, good + bad), F.lit(True)).collect()
    assert {r.query_id for r in found} == set(range(5)) and len(found) == 20
    assert {r.vec_id for r in found} == set(range(5))
    assert ann.search(frame(spark, bad[:4]), F.lit(True)).collect() == []
    assert ann.search(frame(spark, good[:1]), F.lit(True)).collect() == []
    assert ann.search(frame(spark, []), F.lit(True)).collect() == []


def test_parts_are_balanced(clustered):
    parts = ann.balanced_parts(ann.neighbour_graph(clustered[:640]), 16)
    assert sorted(np.bincount(parts)) == [40] * 16


def test_repeated_ids_hide_no_others(spark):
    # one id stands sixty times beside 32 others with its vector; another id has forty vectors, all of them near
    rows = [(0, [1.0, 0.1])] + [(7, [3.0, 1.0])] * 60 + [(100 + k, [3.0, 1.0]) for k in range(32)]
    rows += [(50, [4.0, 1.0 + k / 100]) for k in range(40)] + [(200 + k, [1.0, -k / 10]) for k in range(30)]
    found = ann.search(frame(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [50, 7, *range(100, 118)]
    assert found[0].score == pytest.approx(4.0 + 0.1 * 1.39)
    assert [r.rank for r in found] == list(range(1, 21))
