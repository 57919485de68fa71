"""Sliding-window admission against a plain simulation."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import admission
from tallyspark.operators.admission import HITS, SECOND, _islands, _with_carried, admit, admit_with_state, bucket_budget, bucket_key


def simulate(rows, window_us):
    kept, out = defaultdict(deque), {}
    for key, ts, seq, budget in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        live = kept[key]
        while live and live[0] < ts - window_us:
            live.popleft()
        if len(live) >= budget:
            out[seq] = max(1, int((window_us - (ts - live[0])) / SECOND))
        else:
            live.append(ts)
            out[seq] = None
    return out


def run(spark, rows, window, stretch=3):
    frame = spark.createDataFrame(rows, HITS)
    decided = admit(frame, window, stretch).collect()
    return {r["seq"]: (None if r["admitted"] else r["retry_after"]) for r in decided}


def seconds(times, budget, key="u"):
    return [(key, int(t * SECOND), i, budget) for i, t in enumerate(times)]


@pytest.mark.parametrize(
    "times, budget, waits",
    [
        ([0, 1, 2, 3], 3, [None, None, None, 57]),
        ([0, 10], 1, [None, 50]),
        ([0, 5, 10, 61], 1, [None, 55, 50, None]),
        ([0, 1, 2, 61], 2, [None, None, 58, None]),
        ([0, 60], 1, [None, 1]),
    ],
)
def test_small_logs(spark, times, budget, waits):
    found = run(spark, seconds(times, budget), 60)
    assert [found[i] for i in range(len(times))] == waits


def test_keys_are_independent(spark):
    rows = [("u1", 0, 0, 1), ("u2", 0, 1, 1), ("u1", SECOND, 2, 1)]
    assert run(spark, rows, 60) == {0: None, 1: None, 2: 59}


@pytest.mark.parametrize("stretch", [3, 5, 64])
def test_hot_key_cut_into_stretches_equals_the_chain(spark, stretch):
    draw = random.Random(7)
    rows = []
    # dense and regular traffic never forgets its phase; sparse traffic does
    for i in range(3000):
        rows.append(("hot", i * 700_000 + draw.randrange(3), i, 5))
    for i in range(3000, 4000):
        rows.append((f"k{draw.randrange(20)}", draw.randrange(2100) * SECOND, i, draw.choice([2, 3])))
    expected = simulate(rows, 60 * SECOND)
    # quiet after busy hours, ties at the edge of a window, and times before the epoch
    for i in range(4000, 4600):
        rows.append(("tide", draw.choice([0, 0, 900]) * SECOND + draw.randrange(-300, 300) * SECOND, i, 4))
    expected = simulate(rows, 60 * SECOND)
    assert run(spark, rows, 60, stretch) == expected


def test_state_carries_over_to_later_requests(spark):
    draw = random.Random(3)
    rows = [(f"k{draw.randrange(4)}", draw.randrange(600) * SECOND, i, 3) for i in range(400)]
    expected = simulate(rows, 60 * SECOND)
    carry, found = None, {}
    for low, high in [(0, 200), (200, 210), (210, 600)]:
        part = [r for r in rows if low <= r[1] // SECOND < high]
        decisions, carry = admit_with_state(spark.createDataFrame(part, HITS), 60, 3, carry=carry)
        carry = spark.createDataFrame(carry.collect(), carry.schema)
        found.update({r["seq"]: (None if r["admitted"] else r["retry_after"]) for r in decisions.collect()})
    assert found == expected


def test_bucket_key_and_budget(spark):
    row = spark.range(2).select(
        bucket_key(F.col("id") == 0, F.lit("ip")).alias("key"), bucket_budget(F.col("id") == 0).alias("budget")
    )
    assert [tuple(r) for r in row.collect()] == [("u:ip", 15), ("g:ip", 120)]


def test_only_crowded_requests_are_walked(spark):
    quiet = seconds(range(0, 6000, 40), 2, "quiet")
    rows = quiet + [("busy", t * SECOND, 1000 + t, 2) for t in range(300)]
    islands = _islands(_with_carried(spark.createDataFrame(rows, HITS), None), 60 * SECOND, 3).where("island IS NOT NULL")
    assert {r.key for r in islands.collect()} == {"busy"}


def test_nothing_to_decide(spark):
    decisions, state = admit_with_state(spark.createDataFrame([], HITS), 60)
    assert decisions.collect() == [] and state.collect() == []


def test_late_request_counts_at_the_newest_carried_time(spark):
    carry = spark.createDataFrame([("u", [10 * SECOND, 20 * SECOND])], "key string, live array<bigint>")
    late = spark.createDataFrame([("u", 5 * SECOND, 1, 2), ("v", 5 * SECOND, 2, 2)], HITS)
    decisions, _ = admit_with_state(late, 60, carry=carry)
    assert {r.seq: (r.ts_us, r.admitted, r.retry_after) for r in decisions.collect()} == {
        1: (5 * SECOND, False, 50), 2: (5 * SECOND, True, None),
    }


def test_window_frames_never_slide(spark, monkeypatch):
    # a range frame with two moving ends is added up anew at every row, so a crowd of one key takes time by its square
    plans, stored = [], admission.stored
    keep = lambda df, label: plans.append(df._jdf.queryExecution().toString()) or stored(df, label)
    monkeypatch.setattr(admission, "stored", keep)
    rows = [("hot", i * 500, i, i % 3 + 5) for i in range(5000)]
    assert run(spark, rows, 60) == simulate(rows, 60 * SECOND)
    assert "RangeFrame, unboundedpreceding" in plans[0] and "RangeFrame, -" not in plans[0]
