"""Queries over the job table: summary, listing, reuse, transitions, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.text import error_text
from tallyspark.operators import jobs as ops
from tallyspark.plans.oracle_tables import JOBS, RECORDS, with_tables
from tallyspark.plans.registry import query, stamp
from tallyspark.schema import MONEY_COLUMNS
from tallyspark.session import new_folder, stored
from tallyspark.sources import files, warehouse

NOW = "1998-06-01 12:00:00"
STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _now():
    return F.lit(NOW).cast("timestamp")



# ---------------------------------------------------------------- summary

# amounts as the JSON holds them: every third job spells one amount N/A and one 1e3
_COUNTED = RECORDS + ", " + JOBS + """, held AS (
  SELECT r.*, j.status AS job_status, j.owner_id,
    CASE WHEN r.k % 3 = 0 AND r.page = '6' THEN 0 ELSE total_charges END AS c_total_charges,
    ins_paid AS c_ins_paid, adjustment AS c_adjustment, payments AS c_payments,
    CASE WHEN r.k % 3 = 0 AND r.page = '5' THEN 0 ELSE balance END AS c_balance
  FROM recs r JOIN jobs j ON r.k = j.k), money AS (
  SELECT owner_id, count(*) FILTER (WHERE job_status IN ('completed','failed')) AS records_count,
    count(*) FILTER (WHERE job_status IN ('completed','failed') AND qty > 45) AS row_flags, """ + ", ".join(
    f"coalesce(sum(c_{c}) FILTER (WHERE job_status = 'completed'), 0) AS {c}" for c in MONEY_COLUMNS
) + """
  FROM held GROUP BY owner_id), states AS (
  SELECT owner_id, count(*) AS total, count(*) FILTER (WHERE status='completed') AS completed,
    count(*) FILTER (WHERE status='processing') AS processing, count(*) FILTER (WHERE status='pending') AS pending,
    count(*) FILTER (WHERE status='failed') AS failed, count(*) FILTER (WHERE status='cancelled') AS cancelled,
    count(*) FILTER (WHERE status IN ('completed','failed') AND priority = '1-URGENT') AS doc_flags
  FROM jobs GROUP BY owner_id), summary AS (
  SELECT s.owner_id, total, completed, processing, pending, failed, cancelled,
    coalesce(records_count, 0) AS records_count, coalesce(row_flags, 0) + doc_flags AS flagged_count, """ + ", ".join(
    f"coalesce(m.{c}, 0) AS {c}" for c in MONEY_COLUMNS
) + """
  FROM states s LEFT JOIN money m ON s.owner_id = m.owner_id)"""

_COUNTS = ["total", "completed", "processing", "pending", "failed", "cancelled", "records_count", "flagged_count"]


@query(
    "job_summary_by_owner",
    with_tables(
        _COUNTED,
        "SELECT owner_id, " + ", ".join(_COUNTS) + ", "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_COLUMNS) + " FROM summary",
    ),
)
def job_summary_by_owner(spark, folder):
    """Counts and guarded money totals of every owner, out of stored JSON."""
    return ops.summary(warehouse.jobs_with_json(spark, folder), "owner_id")


@query(
    "job_summary",
    with_tables(
        _COUNTED,
        "SELECT " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _COUNTS) + ", "
        + ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in MONEY_COLUMNS) + " FROM summary",
    ),
)
def job_summary(spark, folder):
    """One row over all jobs."""
    return ops.summary(warehouse.jobs_with_json(spark, folder))


@query(
    "job_envelopes",
    with_tables(
        RECORDS + ", " + JOBS,
        f"""SELECT t.id AS job_id, t.status, t.pdf_path,
  CASE WHEN t.status IN ('completed','failed') THEN coalesce(c.n, 0) ELSE 0 END AS n_records,
  CASE WHEN t.status IN ('completed','failed') THEN coalesce(c.f, 0) + CAST(t.priority = '1-URGENT' AS INTEGER)
    ELSE 0 END AS n_flagged,
  CASE WHEN t.status IN ('completed','failed') THEN c.s END AS charges,
  {STAMP.format('created_at')}, {STAMP.format('completed_at')}, t.duration, t.error
FROM job_times t LEFT JOIN (SELECT k, count(*) AS n, count(*) FILTER (WHERE qty > 45) AS f,
  CAST(sum(total_charges) AS DOUBLE) AS s FROM recs GROUP BY k) c ON t.k = c.k""",
    ),
)
def job_envelopes(spark, folder):
    """Stored JSON parsed back and lifted into the public shape."""
    stored = ops.store_result(warehouse.jobs(spark, folder))
    rows = ops.envelope(ops.parse_result(stored))
    charges = F.aggregate(
        "records", F.lit(0).cast("decimal(28,2)"),
        lambda acc, r: (acc + F.coalesce(r["total_charges"], F.lit(0))).cast("decimal(28,2)"),
    )
    return rows.select(
        "job_id", "status", "pdf_path", F.size("records").alias("n_records"), F.size("flagged").alias("n_flagged"),
        F.when(F.size("records") > 0, charges).cast("double").alias("charges"),
        stamp("created_at"), stamp("completed_at"), F.col("processing_duration_seconds").alias("duration"), "error",
    )


# ---------------------------------------------------------------- visibility

@query(
    "owner_visibility",
    with_tables(
        JOBS,
        """SELECT 'user-' || c_custkey AS viewer_id, count(j.id) AS visible,
  count(j.id) FILTER (WHERE j.status = 'completed') AS completed
FROM customer LEFT JOIN jobs j ON j.owner_id = CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE 'user-' || c_custkey END
GROUP BY c_custkey""",
    ),
)
def owner_visibility(spark, folder):
    """Jobs each viewer sees; a viewer without identity (every tenth here) sees none."""
    viewers = warehouse.table(spark, folder, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("name"),
        F.when(F.col("c_custkey") % 10 != 9, F.concat(F.lit("user-"), F.col("c_custkey").cast("string"))).alias("viewer_id"),
    )
    per_viewer = ops.visible_to(viewers, warehouse.job_rows(spark, folder)).groupBy("viewer_id").agg(
        F.count(F.lit(1)).alias("visible"), F.count_if(F.col("status") == fixed.COMPLETED).alias("completed")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return viewers.join(per_viewer, "viewer_id", "left").select(
        F.col("name").alias("viewer_id"), zero("visible"), zero("completed")
    )


@query(
    "write_check",
    with_tables(
        JOBS,
        "SELECT id, k % 5 <> 0 AND k % 7 <> 0 AS accepted FROM jobs",
    ),
)
def write_check(spark, folder):
    """Writes under an identity that is somebody else's every fifth time and missing every seventh."""
    rows = warehouse.job_rows(spark, folder)
    identity = F.when(F.col("k") % 7 == 0, None).when(F.col("k") % 5 == 0, "user-none").otherwise(F.col("owner_id"))
    return ops.check_owner(rows, identity).select("id", "accepted")


@query(
    "point_lookup",
    with_tables(
        JOBS,
        """SELECT id, CASE WHEN k % 3 = 0 THEN 'user-none' ELSE owner_id END AS viewer_id, k % 3 <> 0 AS found,
  CASE WHEN k % 3 <> 0 THEN status END AS status FROM jobs
UNION ALL SELECT 'job-x' || k, owner_id, FALSE, NULL FROM jobs""",
    ),
)
def point_lookup(spark, folder):
    """Own, foreign and unknown ids; the last two cannot be told apart."""
    rows = warehouse.job_rows(spark, folder)
    foreign = F.when(F.col("k") % 3 == 0, "user-none").otherwise(F.col("owner_id"))
    asked = rows.select("id", foreign.alias("viewer_id")).unionByName(
        rows.select(F.concat(F.lit("job-x"), F.col("k").cast("string")).alias("id"), F.col("owner_id").alias("viewer_id"))
    )
    return ops.point_lookup(asked, rows).select("id", "viewer_id", "found", "status")


# ---------------------------------------------------------------- listing

_LISTED = f"SELECT id, owner_id, status, {STAMP.format('created_at')} FROM job_times"
_ORDER = " ORDER BY job_times.created_at DESC, id DESC"


def _listed(rows):
    return rows.select("id", "owner_id", "status", stamp("created_at"))


@query("jobs_newest_page", with_tables(JOBS, _LISTED + _ORDER + " LIMIT 100"))
def jobs_newest_page(spark, folder):
    return _listed(ops.list_jobs(warehouse.job_rows(spark, folder)))


@query("jobs_offset_page", with_tables(JOBS, _LISTED + " WHERE status = 'pending'" + _ORDER + " LIMIT 50 OFFSET 100"))
def jobs_offset_page(spark, folder):
    return _listed(ops.list_jobs(warehouse.job_rows(spark, folder), "pending", limit=50, offset=100))


@query(
    "jobs_keyset_page",
    with_tables(
        JOBS,
        _LISTED + f" WHERE (job_times.created_at, id) < (TIMESTAMP '{NOW}', 'job-5')" + _ORDER + " LIMIT 200",
    ),
)
def jobs_keyset_page(spark, folder):
    """The page that follows a cursor; an offset given as well does not count."""
    return _listed(ops.list_jobs(warehouse.job_rows(spark, folder), limit=200, offset=7, before=(NOW, "job-5")))


@query("jobs_recent", with_tables(JOBS, _LISTED + _ORDER + " LIMIT 5"))
def jobs_recent(spark, folder):
    return _listed(ops.recent_jobs(warehouse.job_rows(spark, folder)))


@query("jobs_active", with_tables(JOBS, _LISTED + " WHERE status = 'processing'"))
def jobs_active(spark, folder):
    return _listed(ops.active_jobs(warehouse.job_rows(spark, folder)))


# ---------------------------------------------------------------- reuse

def _requests(spark, folder):
    """One submission per order: half of it content of the same year, half of the next one."""
    rows = warehouse.job_rows(spark, folder)
    year = (F.col("order_year") + F.col("k") % 2).cast("string")
    return rows.select(
        F.concat(F.lit("req-"), F.col("k").cast("string")).alias("request_id"),
        "owner_id",
        F.when(F.col("k") % 89 != 0, F.sha2(F.concat("priority", year), 256)).alias("content_hash"),
        (F.col("created_at") + F.expr("interval 1 day")).alias("submitted_at"),
        (F.col("k") % 4 == 0).alias("bypass"),
        F.concat(F.lit("up-"), F.col("k").cast("string"), F.lit(".pdf")).alias("pdf_filename"),
        F.concat(F.lit("/app/pdfs/new/"), F.col("k").cast("string")).alias("pdf_path"),
    )


_REQUESTS = JOBS + """, requests AS (
  SELECT 'req-' || k AS request_id, owner_id, k,
    CASE WHEN k % 89 <> 0 THEN sha256(priority || (order_year + k % 2)) END AS content_hash,
    created_at + INTERVAL 1 DAY AS submitted_at, k % 4 = 0 AS bypass FROM jobs), newest AS (
  SELECT *, row_number() OVER (PARTITION BY owner_id, content_hash,
      CASE WHEN status = 'completed' THEN 'c' WHEN status IN ('pending','processing') THEN 'a' ELSE 'x' END
    ORDER BY created_at DESC, id DESC) AS rn FROM jobs WHERE content_hash IS NOT NULL), cached AS (
  SELECT owner_id, content_hash, id AS cached_id, k AS cached_k FROM newest WHERE rn = 1 AND status = 'completed'),
  active AS (SELECT owner_id, content_hash, id AS active_id FROM newest
    WHERE rn = 1 AND status IN ('pending','processing'))"""


@query(
    "cached_lookup",
    with_tables(
        _REQUESTS,
        """SELECT r.request_id, c.cached_id FROM requests r
LEFT JOIN cached c ON r.owner_id = c.owner_id AND r.content_hash = c.content_hash""",
    ),
)
def cached_lookup(spark, folder):
    found = ops.lookup_by_content(_requests(spark, folder), warehouse.job_rows(spark, folder), [fixed.COMPLETED])
    return found.select("request_id", F.col("hit.id").alias("cached_id"))


@query(
    "inflight_lookup",
    with_tables(
        _REQUESTS,
        """SELECT r.request_id, a.active_id FROM requests r
LEFT JOIN active a ON r.owner_id = a.owner_id AND r.content_hash = a.content_hash""",
    ),
)
def inflight_lookup(spark, folder):
    found = ops.lookup_by_content(_requests(spark, folder), warehouse.job_rows(spark, folder), fixed.LIVE_STATUSES)
    return found.select("request_id", F.col("hit.id").alias("active_id"))


_RESOLVED = _REQUESTS + """, decided AS (
  SELECT r.*, c.cached_id, a.active_id,
    c.cached_id IS NOT NULL AND NOT r.bypass AS reuse,
    CASE WHEN r.content_hash IS NOT NULL AND (c.cached_id IS NULL OR r.bypass) THEN
      first_value(r.request_id) OVER (PARTITION BY r.owner_id, r.content_hash, c.cached_id IS NULL OR r.bypass
        ORDER BY r.submitted_at, r.request_id) END AS creator
  FROM requests r LEFT JOIN cached c ON r.owner_id = c.owner_id AND r.content_hash = c.content_hash
  LEFT JOIN active a ON r.owner_id = a.owner_id AND r.content_hash = a.content_hash), resolved AS (
  SELECT request_id, owner_id, content_hash, k,
    CASE WHEN reuse THEN 'cached' WHEN active_id IS NOT NULL THEN 'joined'
      WHEN creator IS NULL OR creator = request_id THEN 'created' ELSE 'joined' END AS outcome,
    CASE WHEN reuse THEN cached_id ELSE coalesce(active_id, creator, request_id) END AS target_id
  FROM decided)"""


@query(
    "resolve_submissions",
    with_tables(_RESOLVED, "SELECT request_id, owner_id, content_hash, outcome, target_id FROM resolved"),
)
def resolve_submissions(spark, folder):
    return ops.resolve_submissions(_requests(spark, folder), warehouse.job_rows(spark, folder))


@query(
    "submitted_jobs",
    with_tables(
        RECORDS + ", " + _RESOLVED + """, sums AS (
  SELECT k, count(*) AS n, CAST(sum(total_charges) AS DOUBLE) AS charges FROM recs GROUP BY k)""",
        f"""SELECT r.request_id AS id, r.owner_id, 'up-' || r.k || '.pdf' AS pdf_filename,
  CASE WHEN r.outcome = 'cached' THEN j.pdf_path ELSE '/app/pdfs/new/' || r.k END AS pdf_path,
  CASE WHEN r.outcome = 'cached' THEN 'completed' ELSE 'pending' END AS status, r.content_hash,
  CASE WHEN r.outcome = 'cached' THEN (j.k % 5000) / 10000.0 END AS cost_usd,
  CASE WHEN r.outcome = 'cached' THEN CAST(0 AS DOUBLE) END AS duration,
  CASE WHEN r.outcome = 'cached' THEN '{NOW}' END AS completed_at, '{NOW}' AS created_at,
  CASE WHEN r.outcome = 'cached' THEN CAST(coalesce(s.n, 0) AS INTEGER) END AS result_records,
  CASE WHEN r.outcome = 'cached' THEN coalesce(s.charges, 0) END AS result_charges,
  CASE WHEN r.outcome = 'cached' THEN j.k % 5000 + j.k % 700 + 1050 END AS tokens
FROM resolved r LEFT JOIN jobs j ON r.target_id = j.id LEFT JOIN sums s ON j.k = s.k WHERE r.outcome IN ('created', 'cached')""",
    ),
)
def submitted_jobs(spark, folder):
    """Rows that the resolved submissions add to the job table, with the results and usage that they copy."""
    rows, requests = warehouse.job_rows(spark, folder), _requests(spark, folder)
    decisions = stored(ops.resolve_submissions(requests, rows), "decisions")
    # results are large: they are made for the jobs that are copied and cross an exchange for these only
    jobs = warehouse.with_results(spark, folder, ops.copied_jobs(decisions, rows)).drop("k", "priority", "order_year")
    new = ops.jobs_from_submissions(requests, decisions, jobs, _now())
    return new.select(
        "id", "owner_id", "pdf_filename", "pdf_path", "status", "content_hash", "cost_usd",
        F.col("processing_duration_seconds").alias("duration"), stamp("completed_at"), stamp("created_at"),
        F.when(F.col("result").isNotNull(), F.size("result.records")).alias("result_records"),
        F.aggregate(
            "result.records", F.lit(0).cast("decimal(28,2)"),
            lambda sum_, r: (sum_ + F.coalesce(r["total_charges"], F.lit(0))).cast("decimal(28,2)"),
        ).cast("double").alias("result_charges"),
        F.col("token_usage")["total"].alias("tokens"),
    )


@query(
    "stored_jobs",
    with_tables(
        JOBS,
        """SELECT status, count(*) AS jobs, CAST(sum(attempts) AS BIGINT) AS attempts,
  strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS newest FROM jobs GROUP BY status""",
    ),
)
def stored_jobs(spark, folder):
    """The job table appended in two batches, one folder per status, and read back."""
    rows, path = warehouse.job_rows(spark, folder), new_folder(spark, "jobs")
    for batch in (0, 1):
        files.append_jobs(rows.where(F.col("k") % 2 == batch).drop("k", "priority", "order_year"), path)
    return (
        files.read_jobs(spark, path).groupBy("status")
        .agg(F.count(F.lit(1)).alias("jobs"), F.sum("attempts").alias("attempts"), F.max("created_at").alias("newest"))
        .select("status", "jobs", "attempts", stamp("newest"))
    )


@query(
    "expired_uploads",
    with_tables(
        JOBS,
        f"""SELECT pdf_path AS path, k % 1000 AS length, {STAMP.format('created_at')} FROM jobs
WHERE created_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY""",
    ),
)
def expired_uploads(spark, folder):
    """The uploads of all jobs that are past their retention, listed as stored files; none are with a retention of zero."""
    listed = warehouse.job_rows(spark, folder).select(
        F.col("pdf_path").alias("path"), (F.col("k") % 1000).alias("length"), F.col("created_at").alias("modificationTime")
    )
    expired = files.expired_files(listed, _now()).unionByName(files.expired_files(listed, _now(), 0))
    return expired.withColumnRenamed("modificationTime", "created_at").select("path", "length", stamp("created_at"))


@query(
    "insert_if_inactive",
    with_tables(
        _REQUESTS,
        """SELECT request_id AS id FROM (
  SELECT r.*, row_number() OVER (PARTITION BY r.owner_id, r.content_hash ORDER BY submitted_at, request_id) AS rn
  FROM requests r WHERE content_hash IS NOT NULL) r
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM active a WHERE a.owner_id = r.owner_id AND a.content_hash = r.content_hash)""",
    ),
)
def insert_if_inactive(spark, folder):
    """Submissions that may become the one active job of their content."""
    asked = _requests(spark, folder).where(F.col("content_hash").isNotNull()).select(
        F.col("request_id").alias("id"), "owner_id", "content_hash", F.col("submitted_at").alias("created_at")
    )
    return ops.insert_if_inactive(asked, warehouse.job_rows(spark, folder)).select("id")


@query(
    "reuse_while_processing",
    with_tables(
        _REQUESTS,
        """SELECT j.id, j.attempts, c.cached_id AS source_id FROM jobs j
JOIN cached c ON j.owner_id = c.owner_id AND j.content_hash = c.content_hash WHERE j.status = 'processing'""",
    ),
)
def reuse_while_processing(spark, folder):
    return ops.reuse_while_processing(warehouse.job_rows(spark, folder)).select("id", "attempts", "source_id")


# ---------------------------------------------------------------- transitions

_STATE = ["status", "attempts", "error", "started_at", "completed_at", "updated_at"]


def _state(rows):
    return rows.select("id", "status", "attempts", "error", *[stamp(c) for c in _STATE[3:]])


def _state_sql(joins="", **changes):
    shown = {
        "status": "t.status", "attempts": "t.attempts", "error": "t.error", "started_at": "t.started_at",
        "completed_at": "t.completed_at", "updated_at": "t.created_at", **changes,
    }
    cells = [
        f"strftime({sql}, '%Y-%m-%d %H:%M:%S') AS {name}" if name.endswith("_at") else f"{sql} AS {name}"
        for name, sql in shown.items()
    ]
    return f"SELECT t.id, {', '.join(cells)} FROM job_times t {joins}"


_NOW_SQL = f"TIMESTAMP '{NOW}'"


@query(
    "claim_batch",
    with_tables(
        JOBS + """, queue AS (SELECT id AS qid FROM jobs WHERE status = 'pending' ORDER BY created_at, id LIMIT 64)""",
        _state_sql(
            "LEFT JOIN queue ON t.id = qid",
            status="CASE WHEN qid IS NOT NULL THEN 'processing' ELSE t.status END",
            attempts="CASE WHEN qid IS NOT NULL THEN t.attempts + 1 ELSE t.attempts END",
            started_at=f"CASE WHEN qid IS NOT NULL THEN {_NOW_SQL} ELSE t.started_at END",
            updated_at=f"CASE WHEN qid IS NOT NULL THEN {_NOW_SQL} ELSE t.created_at END",
        ),
    ),
)
def claim_batch(spark, folder):
    """The whole table after 64 free workers took the oldest pending jobs."""
    return _state(ops.claim_oldest(warehouse.job_rows(spark, folder), 64, _now()))


_HIT = "(t.status = 'processing' AND t.k % 5 <> 0)"
_NEW = "CASE t.k % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'cancelled' END"


@query(
    "guarded_update",
    with_tables(
        JOBS,
        _state_sql(
            status=f"CASE WHEN {_HIT} THEN {_NEW} ELSE t.status END",
            error=f"CASE WHEN {_HIT} AND t.k % 3 = 1 THEN 'ValueError: <pdf-volume>/x' ELSE t.error END",
            completed_at=f"CASE WHEN {_HIT} THEN {_NOW_SQL} ELSE t.completed_at END",
            updated_at=f"CASE WHEN {_HIT} THEN {_NOW_SQL} ELSE t.created_at END",
        ),
    ),
)
def guarded_update(spark, folder):
    """Terminal writes for every job; only those still processing under the expected attempt count apply."""
    rows = warehouse.job_rows(spark, folder)
    k = F.col("k")
    failure = error_text(F.lit("ValueError"), F.lit("/app/pdfs/x"), "/app/pdfs")
    updates = rows.select(
        "id",
        F.when(k % 3 == 0, fixed.COMPLETED).when(k % 3 == 1, fixed.FAILED).otherwise(fixed.CANCELLED).alias("new_status"),
        F.lit(fixed.PROCESSING).alias("expected_status"),
        F.when(k % 5 == 0, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("expected_attempts"),
        F.when(k % 3 == 1, failure).alias("error"),
    )
    return _state(ops.apply_updates(rows, updates, _now()))


_CANCEL = "(t.status = 'pending' AND t.k % 4 <> 0 AND t.k % 2 = 0)"


@query(
    "cancel_pending",
    with_tables(
        JOBS,
        _state_sql(
            status=f"CASE WHEN {_CANCEL} THEN 'cancelled' ELSE t.status END",
            completed_at=f"CASE WHEN {_CANCEL} THEN {_NOW_SQL} ELSE t.completed_at END",
            updated_at=f"CASE WHEN {_CANCEL} THEN {_NOW_SQL} ELSE t.created_at END",
        ),
    ),
)
def cancel_pending(spark, folder):
    """Cancel requests for every second job, half of them by somebody else."""
    rows = warehouse.job_rows(spark, folder)
    asked = rows.where(F.col("k") % 2 == 0).select(
        "id", F.when(F.col("k") % 4 == 0, "user-none").otherwise(F.col("owner_id")).alias("viewer_id")
    )
    return _state(ops.cancel_pending(rows, asked, _now()))


_STALLED = f"(t.status = 'processing' AND t.started_at < {_NOW_SQL} - INTERVAL 15 MINUTE)"
_SPENT = f"({_STALLED} AND t.attempts >= 3)"


@query(
    "recover_stalled",
    with_tables(
        JOBS,
        _state_sql(
            status=f"CASE WHEN {_SPENT} THEN 'failed' WHEN {_STALLED} THEN 'pending' ELSE t.status END",
            error=f"CASE WHEN {_SPENT} THEN 'Recovered after worker stall; max attempts (3) exhausted' ELSE t.error END",
            completed_at=f"CASE WHEN {_SPENT} THEN {_NOW_SQL} ELSE t.completed_at END",
            updated_at=f"CASE WHEN {_STALLED} THEN {_NOW_SQL} ELSE t.created_at END",
        ),
    ),
)
def recover_stalled(spark, folder):
    return _state(ops.recover_stalled(warehouse.job_rows(spark, folder), _now()))


@query(
    "count_stalled", with_tables(JOBS, f"SELECT count(*) FILTER (WHERE {_STALLED}) AS recovered FROM job_times t")
)
def count_stalled(spark, folder):
    return ops.count_stalled(warehouse.job_rows(spark, folder), _now())


@query(
    "active_sessions",
    """SELECT 'token-' || event_id AS token, user_id, 'user' || user_id || '@example.org' AS email, c_name AS name
FROM events JOIN customer ON user_id = c_custkey
WHERE ts + INTERVAL 8 HOUR > TIMESTAMP '2024-01-20 00:00:00'""",
)
def active_sessions(spark, folder):
    """Sessions opened by events, eight hours each, that are still alive."""
    found = ops.active_sessions(*_sessions(spark, folder))
    return found.select("token", "user_id", "email", "name")


@query(
    "session_lookup",
    """SELECT 'token-' || event_id AS token, user_id, 'user' || user_id || '@example.org' AS email, c_name AS name
FROM events JOIN customer ON user_id = c_custkey JOIN (SELECT DISTINCT o_orderkey AS asked FROM orders) ON asked = event_id
WHERE ts + INTERVAL 8 HOUR > TIMESTAMP '2024-01-20 00:00:00'""",
)
def session_lookup(spark, folder):
    """Tokens asked for by number, one for every order: some live, some expired, some never given out."""
    tokens = warehouse.table(spark, folder, "orders").select(
        F.concat(F.lit("token-"), F.col("o_orderkey").cast("string")).alias("token")
    )
    found = ops.session_lookup(tokens, *_sessions(spark, folder))
    return found.select("token", "user_id", "email", "name")


def _sessions(spark, folder):
    sessions = warehouse.table(spark, folder, "events").select(
        F.concat(F.lit("token-"), F.col("event_id").cast("string")).alias("token"),
        "user_id",
        (F.col("ts").cast("timestamp") + F.expr("interval 8 hours")).alias("expires_at"),
    )
    users = warehouse.table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("user"), F.col("c_custkey").cast("string"), F.lit("@example.org")).alias("email"),
        F.col("c_name").alias("name"),
    )
    return sessions, users, F.lit("2024-01-20 00:00:00").cast("timestamp")
