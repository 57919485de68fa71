"""Job tables as streams: active-job deduplication, stall detection. Live totals are in ``keyed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from tallyspark.operators.jobs import recover_stalled
from tallyspark.streaming.versions import VersionedTable

def first_submissions(events: DataFrame, within: str) -> DataFrame:
    """One submission per owner and content within a time bound, which stands for the job being active.

    The bound is this library's choice: a stream cannot look ahead to the end of the job.
    """
    return events.withWatermark("at", within).dropDuplicatesWithinWatermark(["owner_id", "content_hash"])


def stall_sweep(table: VersionedTable, first: DataFrame, now: Column, timeout_minutes: int, max_attempts: int):
    """``foreachBatch`` function that recovers stalled jobs each time its trigger fires.

    Each batch adds a version to ``table``, from that of the batch before or, at the start, from ``first``. A batch that is
    run again gives the same version again.
    """

    def sweep(_: DataFrame, batch: int) -> None:
        jobs = table.read(before=batch)
        table.write(recover_stalled(first if jobs is None else jobs, now, timeout_minutes, max_attempts), batch)

    return sweep
