"""Request admission over the event log, in batch and as a stream, and job streams."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from tallyspark.operators import admission as ops
from tallyspark.plans.job_tables import NOW
from tallyspark.plans.oracle_tables import JOBS, with_tables
from tallyspark.plans.registry import query, stamp
from tallyspark.session import new_folder
from tallyspark.sources import warehouse
from tallyspark.streaming.admission import StreamAdmission
from tallyspark.streaming.jobs import first_submissions, stall_sweep
from tallyspark.streaming.keyed import DELTA, JOB_STEP, idle_sweep, job_deltas, live_totals
from tallyspark.streaming.versions import VersionedTable

DAY = 86_400


def _chain(key: str, budget: str, window: int = DAY) -> str:
    """Oracle: walk every key request by request, with the accepted times that are still in the window."""
    us = window * 1_000_000
    return f"""WITH RECURSIVE hits AS (SELECT {key} AS key, event_id AS seq, epoch_us(ts) AS t, {budget} AS budget,
    row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS rn FROM events), walk AS (
  SELECT key, seq, t, budget, rn, TRUE AS admitted, [t] AS live, CAST(NULL AS BIGINT) AS retry_after
  FROM hits WHERE rn = 1
  UNION ALL
  SELECT key, seq, t, budget, rn, len(kept) < budget,
    CASE WHEN len(kept) < budget THEN list_append(kept, t) ELSE kept END,
    CASE WHEN len(kept) < budget THEN NULL ELSE greatest(1, ({us} - (t - kept[1])) // 1000000) END
  FROM (SELECT h.key, h.seq, h.t, h.budget, h.rn, list_filter(w.live, lambda x: x >= h.t - {us}) AS kept
    FROM walk w JOIN hits h ON h.key = w.key AND h.rn = w.rn + 1))
SELECT key, seq, t AS ts_us, admitted, retry_after FROM walk"""


def _events(spark, folder):
    return warehouse.table(spark, folder, "events")


def _per_user(events, budget: int):
    return ops.hits(events, F.col("user_id"), F.col("ts"), F.col("event_id"), F.lit(budget))


@query("admission_window", _chain("CAST(user_id AS VARCHAR)", "2"))
def admission_window(spark, folder):
    """Two requests per user and day; the rest is turned away with the time to wait."""
    return ops.admit(_per_user(_events(spark, folder), 2), DAY)


_KEY = "CASE WHEN event_type = 'signup' THEN 'u:' ELSE 'g:' END || user_id"


@query("admission_two_budgets", _chain(_KEY, "CASE WHEN event_type = 'signup' THEN 1 ELSE 3 END"))
def admission_two_budgets(spark, folder):
    """Sign-ups stand for uploads: they count apart from other requests and have a smaller budget."""
    events = _events(spark, folder)
    upload = F.col("event_type") == "signup"
    budget = F.when(upload, 1).otherwise(3)
    hits = ops.hits(events, ops.bucket_key(upload, F.col("user_id")), F.col("ts"), F.col("event_id"), budget)
    return ops.admit(hits, DAY)


@query(
    "admission_totals",
    _chain("'all'", "120", 21_600).replace(
        "SELECT key, seq, t AS ts_us, admitted, retry_after FROM walk",
        "SELECT key, count(*) AS requests, count(*) FILTER (WHERE admitted) AS admitted, "
        "CAST(sum(retry_after) AS BIGINT) AS total_wait FROM walk GROUP BY key",
    ).replace("120 AS budget", "20 AS budget"),
)
def admission_totals(spark, folder):
    """All requests under one key, the extreme hot key: twenty per six hours."""
    events = _events(spark, folder)
    hits = ops.hits(events, F.lit("all"), F.col("ts"), F.col("event_id"), F.lit(20))
    return ops.admit(hits, 21_600).groupBy("key").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("admitted").alias("admitted"),
        F.sum("retry_after").alias("total_wait"),
    )


@query("admission_saturated", _chain("'all'", "20 + event_id % 3", 21_600))
def admission_saturated(spark, folder):
    """Every decision of a key that is over its changing budget all the time."""
    hits = ops.hits(_events(spark, folder), F.lit("all"), F.col("ts"), F.col("event_id"), 20 + F.col("event_id") % 3)
    return ops.admit(hits, 21_600)


# ---------------------------------------------------------------- streams

def _stream(spark: SparkSession, folder: str, name: str):
    """A table as a stream, whether it is one file or a folder of part files."""
    path = f"{folder}/{name}.parquet"
    rows = spark.read.parquet(path)
    stream = spark.readStream.schema(rows.schema)
    if any(file.endswith(f"/{name}.parquet") for file in rows.inputFiles()):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(path)


@query("stream_admission", _chain("CAST(user_id AS VARCHAR)", "2"))
def stream_admission(spark, folder):
    """The same decisions as ``admission_window``, from a stream."""
    job = StreamAdmission(new_folder(spark, "admission"), DAY)
    job.start(_per_user(_stream(spark, folder, "events"), 2)).awaitTermination()
    return job.decisions(spark)


def _job_events(spark, folder):
    """Order rows as a stream of job events: submission time, owner, content and state."""
    return _job_rows(_stream(spark, folder, "orders"))


def _job_rows(orders):
    c = F.col
    low = c("o_orderpriority") == "5-LOW"
    status = (
        F.when(c("o_orderstatus") == "F", "completed")
        .when(c("o_orderstatus") == "O", F.when(low, "cancelled").otherwise("pending"))
        .otherwise(F.when(low, "failed").otherwise("processing"))
    )
    return orders.select(
        F.concat(F.lit("job-"), c("o_orderkey").cast("string")).alias("job_id"),
        F.concat(F.lit("user-"), c("o_custkey").cast("string")).alias("owner_id"),
        F.sha2(F.concat("o_orderpriority", F.year("o_orderdate").cast("string")), 256).alias("content_hash"),
        status.alias("status"),
        c("o_orderdate").cast("timestamp").alias("at"),
    )


def _drain(frame, spark, mode: str, label: str):
    """Run a stream over what there is and give back what it wrote."""
    folder = new_folder(spark, label)

    def keep(batch, number):
        target = f"{folder}/rows" if mode == "complete" else f"{folder}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    stream = frame.writeStream.outputMode(mode).foreachBatch(keep)
    stream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    return rows.drop("batch") if mode != "complete" else rows


def _in_parts(spark, rows, at: str, parts: int, label: str):
    """Give ``rows`` out in ``parts`` equal stretches of time, each added to a folder of its own; yields that folder."""
    folder = new_folder(spark, label)
    rows.write.parquet(f"{folder}-all")
    whole = spark.read.parquet(f"{folder}-all")
    low, high = whole.agg(F.min(at), F.max(at)).first()
    if low is None:
        return
    part = F.expr(f"{parts}L * ({at} - {low}L) div ({high}L - {low}L + 1L)")
    for number in range(parts):
        whole.where(part == number).write.mode("append").parquet(folder)
        yield folder


def _run_out(writer, folder: str) -> None:
    """Run a stream with state over what is new to it, from its checkpoint on.

    State is split once for all batches and not joined by adaptive execution: as many parts as there are cores.
    """
    spark, name = SparkSession.active(), "spark.sql.shuffle.partitions"
    parts = spark.conf.get(name)
    spark.conf.set(name, str(max(1, spark.sparkContext.defaultParallelism)))
    try:
        stream = writer.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        stream.awaitTermination()
    finally:
        spark.conf.set(name, parts)


def _append_to(frame, folder: str) -> None:
    _run_out(frame.writeStream.format("parquet").option("path", f"{folder}/rows").outputMode("append"), folder)


_CLIENT_HITS = """hits AS (SELECT user_id || '|' || event_type AS key, epoch_us(ts) AS t FROM events
  WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL), span AS (SELECT min(t) AS low, max(t) AS high FROM hits),
  parted AS (SELECT key, t, 3 * (t - low) // (high - low + 1) AS part FROM hits, span),
  ends AS (SELECT part, max(max(t)) OVER (ORDER BY part) AS mark FROM parted GROUP BY part),
  marks AS (SELECT p AS part, (SELECT max(mark) FROM ends e WHERE e.part <= p) AS mark FROM range(3) r(p)),
  seen AS (SELECT key, part, max(t) AS newest, lead(part) OVER (PARTITION BY key ORDER BY part) AS next FROM parted GROUP BY key, part)"""


@query(
    "stream_idle_sweep",
    with_tables(
        _CLIENT_HITS,
        """SELECT key, 'seen' AS kind, newest AS newest_us FROM seen
UNION ALL SELECT key, 'forgotten', newest FROM seen JOIN marks ON marks.part = coalesce(next, 3) - 1
WHERE mark > newest + 12 * 3600 * 1000000::BIGINT""",
    ),
)
def stream_idle_sweep(spark, folder):
    """Clients held and forgotten, from a stream that is stopped and started again between three stretches of time."""
    events = _events(spark, folder)
    key = F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type")
    at = F.col("ts").cast("timestamp")
    hits = events.select(key.alias("key"), F.unix_micros(at).alias("ts_us"), at.alias("at"))
    found = new_folder(spark, "idle")
    for source in _in_parts(spark, hits, "ts_us", 3, "hits"):
        rows = spark.readStream.schema(hits.schema).parquet(source)
        _append_to(idle_sweep(rows, 43_200), found)
    return spark.read.schema("key string, kind string, newest_us bigint").parquet(f"{found}/rows")


_LIVE = JOBS + """, line_sums AS (
  SELECT l_orderkey AS k, count(*) AS records, count(*) FILTER (WHERE l_quantity > 45) AS flagged,
    sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS charges FROM lineitem GROUP BY l_orderkey)"""


@query(
    "stream_live_summary",
    with_tables(
        _LIVE,
        """SELECT owner_id, count(*) AS total, count(*) FILTER (WHERE status = 'pending') AS pending,
  count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'completed') AS completed,
  count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'cancelled') AS cancelled,
  count(*) FILTER (WHERE status IN ('pending','processing')) AS live, CAST(coalesce(sum(records), 0) AS BIGINT) AS records,
  CAST(coalesce(sum(flagged), 0) AS BIGINT) AS flagged,
  CAST(coalesce(sum(charges) FILTER (WHERE status = 'completed'), 0) AS DOUBLE) AS charges
FROM jobs LEFT JOIN line_sums ON jobs.k = line_sums.k GROUP BY owner_id""",
    ),
)
def stream_live_summary(spark, folder):
    """Three steps for every job, in three stretches of time: each step takes back what the one before had added."""
    lines = warehouse.order_lines(spark, folder).groupBy(F.concat(F.lit("job-"), F.col("k").cast("string")).alias("_job")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("qty") > 45).alias("flagged"),
        (F.sum("gross") * 100).cast("bigint").alias("charges_cents"),
    )
    jobs = _job_rows(warehouse.table(spark, folder, "orders")).join(lines, F.col("job_id") == F.col("_job"), "left")
    later = lambda days: F.col("at") + F.expr(f"interval {days} days")
    step = lambda status, at, share: F.struct(
        status.alias("status"), at.alias("at"),
        *[F.floor(F.coalesce(c, F.lit(0)) * share).cast("bigint").alias(c) for c in ("records", "flagged", "charges_cents")],
    )
    steps = F.array(
        step(F.lit("pending"), F.col("at"), 0), step(F.lit("processing"), later(300), F.lit(0.5)), step(F.col("status"), later(600), 1)
    )
    history = jobs.select("job_id", "owner_id", F.explode(steps).alias("s")).select("job_id", "owner_id", "s.*")
    history = history.withColumn("at_us", F.unix_micros("at"))
    changes, totals = new_folder(spark, "changes"), new_folder(spark, "totals")

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{totals}/rows/batch={number}")

    for source in _in_parts(spark, history, "at_us", 3, "steps"):
        _append_to(job_deltas(spark.readStream.schema(JOB_STEP).parquet(source), "1 day", DAY * 1000), changes)
        deltas = live_totals(spark.readStream.schema(DELTA).parquet(f"{changes}/rows"))
        _run_out(deltas.writeStream.outputMode("update").foreachBatch(keep), totals)
    names = [c for c in live_totals(spark.createDataFrame([], DELTA)).columns if c != "owner_id"]
    rows = spark.read.parquet(f"{totals}/rows")
    newest = rows.groupBy("owner_id").agg(F.max_by(F.struct(*names), "batch").alias("newest")).select("owner_id", "newest.*")
    return newest.withColumn("charges", (F.col("charges_cents") / 100).cast("double")).drop("charges_cents")


@query(
    "stream_first_submissions",
    "SELECT DISTINCT 'user-' || o_custkey AS owner_id, sha256(o_orderpriority || year(o_orderdate)) AS content_hash FROM orders",
)
def stream_first_submissions(spark, folder):
    """One submission per owner and content while the state is kept; all events fit in the bound here."""
    kept = first_submissions(_job_events(spark, folder), "3650 days")
    return _drain(kept, spark, "append", "first").select("owner_id", "content_hash")


@query(
    "stream_stall_sweep",
    with_tables(
        JOBS,
        f"""SELECT id, CASE WHEN status <> 'processing' OR started_at >= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE THEN status
    WHEN attempts >= 2 THEN 'failed' ELSE 'pending' END AS status,
  CASE WHEN status = 'processing' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE THEN '{NOW}'
    ELSE strftime(created_at, '%Y-%m-%d %H:%M:%S') END AS updated_at FROM job_times""",
    ),
)
def stream_stall_sweep(spark, folder):
    """The job table after timer-driven recoveries of stalled jobs, in several batches, the last one run twice."""
    folder_of = new_folder(spark, "sweep")
    jobs = warehouse.job_rows(spark, folder)
    # a tick per job status, each a file of its own and so a batch
    ticks = jobs.select("status").distinct().repartitionByRange(3, "status")
    ticks.write.parquet(f"{folder_of}/ticks")
    table = VersionedTable(spark, f"{folder_of}/table")
    sweep = stall_sweep(table, jobs, F.lit(NOW).cast("timestamp"), 60, 2)
    source = spark.readStream.schema("status string").option("maxFilesPerTrigger", 1).parquet(f"{folder_of}/ticks")
    stream = source.writeStream.foreachBatch(sweep).option("checkpointLocation", f"{folder_of}/progress")
    stream.trigger(availableNow=True).start().awaitTermination()
    # as after a restart: the table is found in its folder, and the last batch comes once more
    table = VersionedTable(spark, f"{folder_of}/table")
    last = table.versions().agg(F.max("batch")).first()[0]
    stall_sweep(table, jobs, F.lit(NOW).cast("timestamp"), 60, 2)(jobs, last)
    return table.read().select("id", "status", stamp("updated_at"))
