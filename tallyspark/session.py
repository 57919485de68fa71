"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a hot join key even when that costs one more exchange above the join
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # collected parts of segments: more groups in memory before an aggregation turns to sorting
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "2048",
    # state of streams on disk beside memory; keyed state with timers needs it
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # texts are large: fewer rows at once in Python tasks
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


# settings that only a new session can take
STARTUP_CONF = {
    # extraction builds large expressions; do not look up a call site for each small part of them
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def new_session(name: str, master: str | None = None, **conf: str) -> SparkSession:
    """A tuned session; without a master the one of the cluster launcher is used."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**STARTUP_CONF, **RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every query here relies on, and give the executors this package."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    send_package(spark)
    return spark


def send_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, from whatever folder the driver runs in."""
    context = spark.sparkContext
    name = f"{__package__}.zip"
    if any(os.path.basename(path) == name for path in context.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # the driver serves the archive to the executors itself, so its place need not be shared
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{__package__}-"), name)
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for file in sorted(files):
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(archive)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, from ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="tallyspark-")
            context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Later steps neither recompute it nor depend on executors, and a loop starts each round from a fresh plan
    with real file sizes (a checkpoint would keep the predicates it was derived from, which pile up in loops).
    """
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unsent(df: DataFrame) -> DataFrame:
    """``df``, which no join sends to all executors; for tables that Spark sizes too low, as below an explode.

    Spark takes an explode to give a row for each of its rows, so that a table many times larger than the limit of a
    broadcast would be collected by the driver.
    """
    return df.hint("merge")
