"""Streams with state per key and event-time timers: idle clients, and live totals that take back what they added.

Rows of a key may come in any order inside a batch: only the newest counts, so a hot key needs one row of state. Keys are
dealt into ``BUCKETS`` buckets by their hash, and the state of a bucket is one value, the Arrow table of its keys: a batch
calls Python once a bucket, not once a key. A bucket has one timer, due with the first of its keys. State lies in RocksDB
(``session.RUNTIME_CONF``) and in the checkpoint, so a restart goes on from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyspark import fixed

SIGHTING = "key string, kind string, newest_us bigint"
JOB_STEP = (
    "job_id string, owner_id string, status string, at timestamp, records bigint, flagged bigint, charges_cents bigint"
)
_ADDED = ["records", "flagged", "charges_cents"]
DELTA = "owner_id string, status string, jobs bigint, records bigint, flagged bigint, charges_cents bigint"
MILLI = 1000
FINAL = [status for status in fixed.STATUSES if status not in fixed.LIVE_STATUSES]
# each bucket costs some Python calls a batch; 10,000 keys are about a megabyte of state
BUCKETS = 256


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class _Bucketed(StatefulProcessor):
    """State of a bucket of keys: a frame with the columns of ``empty`` and ``due``, the milliseconds a key goes after (0: never)."""

    empty: pd.DataFrame

    def init(self, handle) -> None:
        self.handle = handle
        self.keys = handle.getValueState("keys", "timer bigint, held binary")

    def _read(self) -> tuple[int, pd.DataFrame]:
        """The timer of the bucket (0: none) and its keys."""
        if not self.keys.exists():
            return 0, self.empty
        timer, held = self.keys.get()
        return timer, pa.ipc.open_stream(held).read_pandas()

    def _write(self, timer: int, held: pd.DataFrame) -> None:
        """Keep ``held``; the timer goes to the first key that is due."""
        due = held["due"][held["due"] > 0]
        first = int(due.min()) if len(due) else 0
        if first != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if first:
                self.handle.registerTimer(first)
        if not len(held):
            self.keys.clear()
            return
        table = pa.Table.from_pandas(held, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.keys.update((first, sink.getvalue().to_pybytes()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        mark = max(fired + 1, timerValues.getCurrentWatermarkInMs())
        timer, held = self._read()
        over = (held["due"] > 0) & (held["due"] < mark)
        # a timer that has fired is gone by itself
        self._write(0 if timer == fired else timer, held[~over])
        return self.left(held[over])

    def left(self, keys: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """What is said of keys that go."""
        return iter(())

    def close(self) -> None:
        pass


class IdleSweep(_Bucketed):
    """Keeps a key from its first request until no request came for a window; emits ``seen`` and ``forgotten`` rows."""

    empty = pd.DataFrame({"key": pd.Series(dtype=object), "newest_us": pd.Series(dtype="int64"), "due": pd.Series(dtype="int64")})

    def __init__(self, window_us: int):
        self.window_us = window_us

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = pd.concat([batch.groupby("key")["ts_us"].max() for batch in rows]).groupby(level=0).max()
        timer, held = self._read()
        newest = pd.concat([held.set_index("key")["newest_us"], latest]).groupby(level=0).max().astype("int64")
        # the next whole millisecond after the window
        due = (newest + self.window_us) // MILLI + 1
        self._write(timer, pd.DataFrame({"key": newest.index, "newest_us": newest.to_numpy(), "due": due.to_numpy()}))
        seen = newest[latest.index]
        yield pd.DataFrame({"key": seen.index, "kind": "seen", "newest_us": seen.to_numpy()})

    def left(self, keys: pd.DataFrame) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"key": keys["key"], "kind": "forgotten", "newest_us": keys["newest_us"]})


def idle_sweep(requests: DataFrame, window_seconds: float) -> DataFrame:
    """``SIGHTING`` rows of a stream ``requests(key, ts_us, at)``; ``at`` is the event time of ``ts_us``.

    A key's state goes once the watermark, which is the latest time of the batches before, has left its newest request
    behind by more than the window. Rows without a key or time take no part.
    """
    rows = requests.where("key IS NOT NULL AND ts_us IS NOT NULL").withWatermark("at", "0 seconds")
    processor = IdleSweep(int(window_seconds * 1_000_000))
    return rows.withColumn("bucket", _bucket("key")).groupBy("bucket").transformWithStateInPandas(processor, SIGHTING, "append", "EventTime")


class JobDeltas(_Bucketed):
    """Keeps the newest step of a job; emits what it added before as a negative row and what it adds now."""

    # of steps at one time the last status in the alphabet, as everywhere; then by the other values
    order = ["at_us", "status", "owner_id", *_ADDED]
    empty = pd.DataFrame(
        {c: pd.Series(dtype=object if c in ("job_id", "status", "owner_id") else "int64") for c in ["job_id", *order, "due"]}
    )

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def _newest(self, steps: pd.DataFrame) -> pd.DataFrame:
        return steps.sort_values(["job_id", *self.order]).drop_duplicates("job_id", keep="last")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = self._newest(pd.concat([self._newest(batch[["job_id", *self.order]]) for batch in rows]))
        timer, held = self._read()
        before = held[["job_id", *self.order]]
        newest = self._newest(pd.concat([before, came]).astype(self.empty.dtypes.drop("due")))
        # a step that changes nothing is in both
        moved = pd.concat([before, newest]).drop_duplicates(keep=False)["job_id"].unique()
        if not len(moved):
            return
        final = newest["status"].isin(FINAL)
        self._write(timer, newest.assign(due=(newest["at_us"] // MILLI + self.keep_ms).where(final, 0)))
        for steps, sign in ((before, -1), (newest, 1)):
            changed = steps[steps["job_id"].isin(moved)]
            values = {c: sign * changed[c] for c in _ADDED}
            yield pd.DataFrame({"owner_id": changed["owner_id"], "status": changed["status"], "jobs": sign, **values})


def job_deltas(steps: DataFrame, late: str, late_ms: int) -> DataFrame:
    """``DELTA`` rows of a stream of ``JOB_STEP`` rows: their sums are the totals over the newest step of every job.

    Steps later than ``late`` (``late_ms`` in milliseconds) are left out. The state of a job that has ended goes when no step of
    it can come any more; that of a live job stays. Rows without a job, owner, status or time take no part, null counts are zero.
    """
    known = steps.where("job_id IS NOT NULL AND owner_id IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL")
    rows = known.fillna(0, _ADDED).withColumn("at_us", F.unix_micros("at")).withWatermark("at", late)
    return rows.withColumn("bucket", _bucket("job_id")).groupBy("bucket").transformWithStateInPandas(JobDeltas(late_ms), DELTA, "append", "EventTime")


def live_totals(deltas: DataFrame) -> DataFrame:
    """Jobs per state, records, flags and money per owner, from a stream of ``DELTA`` rows; for update mode.

    Records and flags count in every state, money of completed jobs only.
    """
    jobs = lambda *statuses: F.sum(F.when(F.col("status").isin(*statuses), F.col("jobs")).otherwise(0))
    return deltas.groupBy("owner_id").agg(
        F.sum("jobs").alias("total"),
        *[jobs(s).alias(s) for s in fixed.STATUSES],
        jobs(*fixed.LIVE_STATUSES).alias("live"),
        F.sum("records").alias("records"),
        F.sum("flagged").alias("flagged"),
        F.sum(F.when(F.col("status") == fixed.COMPLETED, F.col("charges_cents")).otherwise(0)).alias("charges_cents"),
    )
