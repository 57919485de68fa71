"""Keyed stream state: repeated, late and null rows, over a restart."""

from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from tallyspark.session import new_folder, tune
from tallyspark.streaming.keyed import JOB_STEP, IdleSweep, JobDeltas, job_deltas

START = datetime(2024, 1, 1)


def test_deltas_add_up_to_the_newest_steps(spark):
    tune(spark)
    source, out = new_folder(spark, "steps"), new_folder(spark, "deltas")
    step = lambda job, status, hours, records=0, owner="o": (job, owner, status, START + timedelta(hours=hours), records, None, 5)
    batches = [
        [step("a", "pending", 0), step("a", "pending", 0), step("b", "processing", 2, 1), step("b", "pending", 1),
         step(None, "pending", 0), step("c", "pending", 0, owner=None), ("d", "o", "pending", None, 1, 1, 1)],
        [step("a", "completed", 100, 7), step("b", "failed", 60, 2), step("b", "processing", 2, 1)],
        # later than a day behind the newest step: left out
        [step("a", "pending", 3, 50), step("e", "pending", 1), step("f", "pending", 99, 4)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, JOB_STEP).write.mode("append").parquet(source)
        deltas = job_deltas(spark.readStream.schema(JOB_STEP).parquet(source), "1 day", 86_400_000)
        stream = deltas.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress")
        stream.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    sums = spark.read.parquet(f"{out}/rows").groupBy("owner_id", "status").agg(*[F.sum(c).alias(c) for c in ("jobs", "records", "flagged")])
    left = {(r.owner_id, r.status): (r.jobs, r.records, r.flagged) for r in sums.collect() if r.jobs}
    assert left == {("o", "completed"): (1, 7, 0), ("o", "failed"): (1, 2, 0), ("o", "pending"): (1, 4, 0)}


class Handle:
    """State of one bucket, in memory; its timers and its one value."""

    def __init__(self):
        self.timers, self.value, self.mark = set(), None, 0
        self.registerTimer, self.deleteTimer = self.timers.add, self.timers.remove

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def getCurrentWatermarkInMs(self):
        return self.mark

    def fire(self, processor, mark):
        """Rows of the timers due at a watermark."""
        self.mark, out = mark, []
        for timer in sorted(t for t in self.timers if t < mark):
            self.timers.remove(timer)
            self.getExpiryTimeInMs = lambda: timer
            out += [r for frame in processor.handleExpiredTimer((0,), self, self) for r in frame.itertuples(index=False, name=None)]
        return out


def given(processor, handle, *batches):
    frames = processor.handleInputRows((0,), iter(batches), handle)
    return sorted(r for frame in frames for r in frame.itertuples(index=False, name=None))


def test_one_call_takes_all_keys_of_a_bucket():
    handle, sweep = Handle(), IdleSweep(1_000_000)
    sweep.init(handle)
    hits = lambda *rows: pd.DataFrame(rows, columns=["key", "ts_us"])
    first = given(sweep, handle, hits(("a", 5), ("b", 7_000_000)), hits(("a", 2_000_000), ("c", 1)))
    assert first == [("a", "seen", 2_000_000), ("b", "seen", 7_000_000), ("c", "seen", 1)]
    assert given(sweep, handle, hits(("a", 9))) == [("a", "seen", 2_000_000)] and len(handle.timers) == 1
    assert handle.fire(sweep, 1001) == []
    assert handle.fire(sweep, 7000) == [("a", "forgotten", 2_000_000), ("c", "forgotten", 1)]
    assert handle.timers == {8001} and handle.fire(sweep, 8002) == [("b", "forgotten", 7_000_000)]
    assert not handle.timers and not handle.exists()


def test_one_call_takes_all_jobs_of_a_bucket():
    handle, deltas = Handle(), JobDeltas(1000)
    deltas.init(handle)
    steps = lambda *rows: pd.DataFrame(rows, columns=["job_id", "owner_id", "status", "at_us", "records", "flagged", "charges_cents"])
    a, b = ("a", "o", "pending", 0, 0, 0, 0), ("b", "o", "completed", 5_000, 3, 1, 9)
    assert given(deltas, handle, steps(a, b), steps(a)) == [("o", "completed", 1, 3, 1, 9), ("o", "pending", 1, 0, 0, 0)]
    assert given(deltas, handle, steps(a, ("b", "o", "processing", 1, 1, 1, 1))) == []
    again = given(deltas, handle, steps(("a", "o", "failed", 9_000, 2, 0, 4)))
    assert again == [("o", "failed", 1, 2, 0, 4), ("o", "pending", -1, 0, 0, 0)] and handle.timers == {1005}
    # a job that has ended goes when it is due, the other one later
    assert handle.fire(deltas, 1006) == [] and handle.timers == {1009}
