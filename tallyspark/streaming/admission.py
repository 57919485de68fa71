"""Sliding-window admission over a request stream.

Every micro-batch runs the batch operator with the accepted times the last batch left behind, so a hot key is
split over time slices here as well. State and decisions are written per batch under the batch number: a
batch that is run again after a failure reads the same state and replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyspark.operators.admission import CARRY, admit_with_state


class StreamAdmission:
    """``requests`` is a streaming frame shaped like ``operators.admission.HITS``.

    Requests are taken in time order within a micro-batch, and batches in arrival order. Idle keys are
    forgotten one window after the latest request seen.
    """

    def __init__(self, folder: str, window_seconds: float):
        self.folder = folder.rstrip("/")
        self.window_seconds = window_seconds

    def _state_path(self, batch: int) -> str:
        return f"{self.folder}/state/batch={batch}"

    def process(self, requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        carry = spark.read.schema(CARRY).parquet(self._state_path(batch - 1)) if batch > 0 else None
        decisions, state = admit_with_state(requests, self.window_seconds, carry=carry)
        decisions.write.mode("overwrite").parquet(f"{self.folder}/decisions/batch={batch}")
        state.write.mode("overwrite").parquet(self._state_path(batch))

    def start(self, requests: DataFrame, **trigger) -> StreamingQuery:
        return (
            requests.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def decisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/decisions").drop("batch")

    def state(self, spark: SparkSession) -> DataFrame:
        """Accepted times per key that the latest batch left behind."""
        batches = spark.read.parquet(f"{self.folder}/state")
        latest = batches.agg(F.max("batch")).first()[0]
        return batches.where(F.col("batch") == latest).select("key", "live")
