"""Files in and out: binary documents, ground truth, predictions, reports, job tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyspark import fixed
from tallyspark.schema import MONEY_COLUMNS, PAGES

_MONEY_TRUTH = ["totalCharges", "insPaid", "adjustment", "payments", "balance"]


def _records(names: list[str], lists: list[str], money: list[str]) -> str:
    kind = lambda n: "array<string>" if n in lists else "double" if n in money else "string"
    return "array<struct<" + ",".join(f"{n}:{kind(n)}" for n in names) + ">>"


TRUTH_RECORDS = _records(
    [t for t, _ in fixed.SCORED_FIELDS], ["cptCodes", "insurers", "thirdParties"], _MONEY_TRUTH
)
PREDICTED_RECORDS = _records(
    [p for _, p in fixed.SCORED_FIELDS], ["cpt_codes", "insurers", "third_parties"], MONEY_COLUMNS
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts stored as parquet, numbered from one within each document."""
    return spark.read.schema(PAGES).parquet(path)


def read_binary_documents(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under ``root`` at any depth; a root that is not there has none.

    Spark lists no files of zero bytes, so empty ones never get in.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    try:
        return reader.load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")


def admission_state(content: Column, length: Column, max_bytes: int = fixed.MAX_FILE_BYTES) -> Column:
    magic = F.encode(F.lit(fixed.FILE_MAGIC), "UTF-8")
    return (
        F.when(length > max_bytes, "too_large")
        .when(length == 0, "empty")
        .when(F.substring(content, 1, len(fixed.FILE_MAGIC)) != magic, "not_pdf")
        .otherwise("accepted")
    )


def admit_documents(files: DataFrame, max_bytes: int = fixed.MAX_FILE_BYTES) -> DataFrame:
    """State and SHA-256 fingerprint per file; too large files are refused by length, their bytes unread."""
    state = admission_state(F.col("content"), F.col("length"), max_bytes)
    small = files.where(F.col("length") <= max_bytes).select("path", "length", "modificationTime", "content")
    large = files.where(F.col("length") > max_bytes).select("path", "length", "modificationTime")
    read = small.select("path", "length", state.alias("state"), F.sha2("content", 256).alias("_hash"))
    accepted = read.select(
        "path", "length", "state", F.when(F.col("state") == "accepted", F.col("_hash")).alias("content_hash")
    )
    refused = large.select(
        "path", "length", F.lit("too_large").alias("state"), F.lit(None).cast("string").alias("content_hash")
    )
    return accepted.unionByName(refused)


def expired_files(files: DataFrame, now: Column, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Files last changed strictly more than ``days`` ago; none when the retention is switched off."""
    rows = files.select("path", "length", "modificationTime")
    if days <= 0:
        return rows.where(F.lit(False))
    return rows.where(F.col("modificationTime") < now - F.expr(f"interval {int(days)} days"))


def read_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Ground truth ``(doc_id, records)`` from ``*_gt.json``."""
    return (
        spark.read.schema(f"doc_id string, records {TRUTH_RECORDS}")
        .option("multiLine", "true")
        .option("pathGlobFilter", "*_gt.json")
        .json(folder)
        .select("doc_id", F.coalesce("records", F.array()).alias("records"))
    )


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions ``(doc_id, records)``; ``<doc>.json`` wins over ``<doc>_pred.json``."""
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.json$", "")
    files = (
        spark.read.schema(f"records {PREDICTED_RECORDS}")
        .option("multiLine", "true")
        .option("pathGlobFilter", "*.json")
        .json(folder)
        .select(F.url_decode(name).alias("_name"), F.coalesce("records", F.array()).alias("records"))
    )
    # a file named like a prediction may also be the plain file of a document with such a name
    plain = files.select(F.col("_name").alias("doc_id"), F.lit(1).alias("_rank"), "records")
    marked = files.where(F.col("_name").endswith("_pred")).select(
        F.regexp_replace("_name", "_pred$", "").alias("doc_id"), F.lit(0).alias("_rank"), "records"
    )
    return (
        plain.unionByName(marked)
        .groupBy("doc_id")
        .agg(F.max_by("records", "_rank").alias("records"))
    )


def write_report(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def append_jobs(jobs: DataFrame, path: str) -> None:
    """Append rows to a job table, one folder per status so that status filters prune files."""
    jobs.write.mode("append").partitionBy("status").parquet(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_jdbc_jobs(spark: SparkSession, url: str, table: str, properties: dict, partitions: int, lower: str, upper: str) -> DataFrame:
    """Job table of a database, read in parallel ranges of ``created_at``."""
    return spark.read.jdbc(
        url, table, column="created_at", lowerBound=lower, upperBound=upper, numPartitions=partitions,
        properties=properties,
    )


def write_jdbc_jobs(jobs: DataFrame, url: str, table: str, properties: dict) -> None:
    jobs.write.jdbc(url, table, mode="append", properties=properties)
