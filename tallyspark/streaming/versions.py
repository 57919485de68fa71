"""A table in versions, one per batch of a stream, kept in the shared folder with a log of what is complete."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


class VersionedTable:
    """Versions of a table under ``folder``; nothing about them is held by the driver.

    A batch writes its own folder and then an entry of the log, so a version that broke off is never read. A batch reads
    the newest version of an earlier batch: when it is run again, after a restart or a lost executor, it reads what it read
    before and replaces only what it wrote itself. Batches of one table run one after the other, as a stream does.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self.folder}/version-{batch}"

    def versions(self) -> DataFrame | None:
        """``(path, batch)`` of the complete versions; none before the first one."""
        try:
            return self.spark.read.schema("path string, batch long").parquet(f"{self.folder}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def read(self, before: int | None = None) -> DataFrame | None:
        """The newest complete version, of a batch earlier than ``before`` if given; None when there is none."""
        log = self.versions()
        if log is None:
            return None
        earlier = log if before is None else log.where(F.col("batch") < before)
        newest = earlier.agg(F.max_by("path", "batch").alias("path")).first().path
        return None if newest is None else self.spark.read.parquet(newest)

    def write(self, frame: DataFrame, batch: int) -> None:
        frame.write.mode("overwrite").parquet(self._path(batch))
        entry = self.spark.range(1).select(F.lit(self._path(batch)).alias("path"))
        entry.write.mode("overwrite").parquet(f"{self.folder}/log/batch={batch}")
