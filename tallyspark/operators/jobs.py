"""Job tables: envelopes, owner scope, summary, paging, reuse, and state transitions.

Every transition takes the table and returns its next version; ``now`` is a parameter, so that a retried task
writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark import fixed
from tallyspark.functions.money import guarded_number
from tallyspark.operators.paging import Places
from tallyspark.schema import MONEY_COLUMNS, RESULT

NEWEST = ("created_at", "id")


# ---------------------------------------------------------------- visibility

def owner_scope(jobs: DataFrame, owner_id: str | None) -> DataFrame:
    """Rows of one owner; without an identity no row at all."""
    return jobs.where(F.col("owner_id") == F.lit(owner_id).cast("string"))


def visible_to(viewers: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows each viewer may see, for a table of ``viewer_id``; a null viewer sees nothing."""
    return viewers.join(jobs, F.col("viewer_id") == F.col("owner_id"))


def check_owner(rows: DataFrame, identity: Column) -> DataFrame:
    """Mark rows whose owner is the writing identity; the rest must not be written."""
    return rows.withColumn("accepted", F.coalesce(F.col("owner_id") == identity, F.lit(False)))


def require_owner(rows: DataFrame, owner_id: str) -> DataFrame:
    """The rows themselves; the job fails when one belongs to somebody else."""
    wrong = F.raise_error(F.concat(F.lit("row of another owner: "), F.coalesce("owner_id", F.lit("none"))))
    return rows.withColumn(
        "owner_id", F.when(F.col("owner_id").eqNullSafe(F.lit(owner_id)), F.col("owner_id")).otherwise(wrong)
    )


def point_lookup(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """``requests(viewer_id, id)`` with ``found``; absent and foreign rows look the same."""
    own = jobs.select("id", F.col("owner_id").alias("viewer_id"), "status")
    return requests.join(own, ["id", "viewer_id"], "left").withColumn("found", F.col("status").isNotNull())


# ---------------------------------------------------------------- envelope and JSON

def parse_result(jobs: DataFrame) -> DataFrame:
    """Typed ``result`` from its stored JSON text."""
    return jobs.withColumn("result", F.from_json("result", RESULT))


def store_result(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("result", F.to_json("result"))


def envelope(jobs: DataFrame) -> DataFrame:
    """Public shape of a job: results lifted out, never null."""
    part = lambda name: F.coalesce(F.col(f"result.{name}"), F.array()).alias(name)
    return jobs.select(
        F.col("id").alias("job_id"),
        "status", "pdf_path",
        part("records"), part("flagged"),
        "created_at", "completed_at", "token_usage", "cost_usd", "processing_duration_seconds", "error",
    )


# ---------------------------------------------------------------- summary

def _json_array(result: Column, name: str) -> Column:
    """Elements of a JSON array member; null when it is anything but an array."""
    return F.try_variant_get(result, f"$.{name}", "array<variant>")


def summary(jobs: DataFrame, *keys: str) -> DataFrame:
    """Status counts, record and flag counts over all states, money of completed jobs.

    ``result`` is JSON text. Money counts only where it reads as a plain decimal number. The amounts of one
    job are added up inside its row, so that one partial aggregation serves counts and totals alike.
    """
    parsed = jobs.select(*keys, "status", F.try_parse_json("result").alias("_v"))
    arrays = parsed.select(
        *keys,
        "status",
        _json_array(F.col("_v"), "records").alias("_records"),
        F.size(_json_array(F.col("_v"), "flagged")).alias("_flagged"),
    )
    zero = F.lit(0).cast("decimal(38,6)")

    def money(name: str) -> Column:
        values = F.transform(
            "_records", lambda r: guarded_number(F.try_variant_get(r, f"$.{name}", "string"))
        )
        total = F.aggregate(
            F.array_compact(values), zero, lambda acc, v: (acc + v).cast("decimal(38,6)")
        )
        return F.when(F.col("status") == fixed.COMPLETED, total)

    per_job = arrays.select(
        *keys,
        "status",
        F.when(F.col("_records").isNotNull(), F.size("_records")).alias("_n"),
        F.when(F.col("_flagged") >= 0, F.col("_flagged")).alias("_flagged"),
        *[money(name).alias(name) for name in MONEY_COLUMNS],
    )
    status = F.col("status")
    return per_job.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in ("completed", "processing", "pending", "failed", "cancelled")],
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records_count"),
        F.coalesce(F.sum("_flagged"), F.lit(0)).alias("flagged_count"),
        *[F.coalesce(F.sum(name), zero).cast("double").alias(name) for name in MONEY_COLUMNS],
    )


# ---------------------------------------------------------------- listing

def with_status(jobs: DataFrame, status: str | None) -> DataFrame:
    return jobs if status is None else jobs.where(F.col("status") == status)


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id"))


def list_jobs(
    jobs: DataFrame,
    status: str | None = None,
    limit: int | None = fixed.LIST_LIMIT_DEFAULT,
    offset: int = 0,
    before: tuple[str | None, str | None] | None = None,
) -> DataFrame:
    """Newest first; a cursor ``(created_at, id)`` wins over an offset. No limit lists everything."""
    if limit is not None and not 1 <= limit <= fixed.LIST_LIMIT_MAX:
        raise ValueError(f"limit must be between 1 and {fixed.LIST_LIMIT_MAX}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    rows = with_status(jobs, status)
    if before is not None:
        created_at, job_id = before
        if (created_at is None) != (job_id is None):
            raise ValueError("a cursor needs both created_at and id")
        if created_at is not None:
            cursor = F.struct(F.lit(created_at).cast("timestamp"), F.lit(job_id))
            rows, offset = rows.where(F.struct(*NEWEST) < cursor), 0
    if offset:
        return Places(rows, dict.fromkeys(NEWEST, True)).from_place(rows, offset, limit)
    rows = newest_first(rows)
    return rows if limit is None else rows.limit(limit)


def active_jobs(jobs: DataFrame) -> DataFrame:
    return list_jobs(jobs, fixed.PROCESSING, limit=None)


def recent_jobs(jobs: DataFrame) -> DataFrame:
    return newest_first(list_jobs(jobs, limit=fixed.RECENT_FETCHED)).limit(fixed.RECENT_SHOWN)


# ---------------------------------------------------------------- reuse by content

REUSED = ["result", "token_usage", "cost_usd", "pdf_path"]


def newest_by_content(jobs: DataFrame, statuses: list[str], *carry: str) -> DataFrame:
    """Newest job per owner and content among the given states.

    An aggregate rather than a ranking, so that a hot key is reduced before the shuffle.
    """
    row = F.struct(*NEWEST, *carry)
    order = F.struct(*NEWEST)
    return (
        jobs.where(F.col("status").isin(statuses) & F.col("content_hash").isNotNull())
        .groupBy("owner_id", "content_hash")
        .agg(F.max_by(row, order).alias("hit"))
    )


def lookup_by_content(requests: DataFrame, jobs: DataFrame, statuses: list[str], *carry: str) -> DataFrame:
    """Requests joined with the newest matching job of the same owner, null where there is none."""
    return requests.join(newest_by_content(jobs, statuses, *carry), ["owner_id", "content_hash"], "left")


def resolve_submissions(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Decide each submission: reuse a completed result, join an in-flight job, or create a new one.

    ``requests(request_id, owner_id, content_hash, submitted_at, bypass)``. Bypassing skips the completed
    look-up, yet an in-flight twin still absorbs the request, as at most one job per content may be active.
    Returns ``request_id, owner_id, content_hash, outcome, target_id``; ``target_id`` is the job reused or
    joined, or the request that creates the job.
    """
    keys = ["owner_id", "content_hash"]
    order = F.struct(*NEWEST)
    newest = lambda statuses, name: F.max_by(
        F.when(F.col("status").isin(statuses), F.col("id")),
        F.when(F.col("status").isin(statuses), order),
    ).alias(name)
    known = (
        jobs.where(F.col("content_hash").isNotNull())
        .groupBy(*keys)
        .agg(newest([fixed.COMPLETED], "cached_id"), newest(fixed.LIVE_STATUSES, "active_id"))
    )
    first = F.struct("submitted_at", "request_id")
    asked = (
        requests.where(F.col("content_hash").isNotNull())
        .groupBy(*keys)
        .agg(
            F.min(first).alias("_first"),
            F.min(F.when(F.col("bypass"), first)).alias("_first_bypass"),
        )
    )
    plan = asked.join(known, keys, "left").select(
        *keys,
        "cached_id",
        "active_id",
        F.when(F.col("cached_id").isNull(), F.col("_first.request_id"))
        .otherwise(F.col("_first_bypass.request_id"))
        .alias("creator"),
    )
    reuse = F.col("cached_id").isNotNull() & ~F.col("bypass")
    outcome = (
        F.when(reuse, "cached")
        .when(F.col("active_id").isNotNull(), "joined")
        .when(F.col("creator").isNull() | (F.col("creator") == F.col("request_id")), "created")
        .otherwise("joined")
    )
    target = F.when(reuse, F.col("cached_id")).otherwise(
        F.coalesce("active_id", "creator", "request_id")
    )
    return requests.join(plan, keys, "left").select(
        "request_id", *keys, outcome.alias("outcome"), target.alias("target_id")
    )


def copied_jobs(decisions: DataFrame, jobs: DataFrame) -> DataFrame:
    """The rows of ``jobs`` that ``decisions`` copy, so that results need to be read or made for these only."""
    copied = decisions.where(F.col("outcome") == "cached").select(F.col("target_id").alias("id"))
    return jobs.join(copied, "id", "left_semi")


def jobs_from_submissions(requests: DataFrame, decisions: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """The rows that resolved submissions add: new pending jobs and completed copies.

    ``requests`` also holds ``pdf_filename`` and ``pdf_path``; of ``jobs``, ``copied_jobs`` are enough. Append the result to
    the table.
    """
    new = decisions.where(F.col("outcome").isin("created", "cached")).select("request_id", "outcome", "target_id")
    cached = jobs.select(F.col("id").alias("target_id"), F.struct(*REUSED).alias("_old"))
    rows = requests.join(new, "request_id").join(cached, "target_id", "left")
    is_copy = F.col("outcome") == "cached"
    kinds = {f.name: f.dataType for f in jobs.schema.fields}
    values = {
        "id": F.col("request_id"),
        "owner_id": F.col("owner_id"),
        "pdf_filename": F.col("pdf_filename"),
        "pdf_path": F.when(is_copy, F.col("_old.pdf_path")).otherwise(F.col("pdf_path")),
        "status": F.when(is_copy, fixed.COMPLETED).otherwise(fixed.PENDING),
        "content_hash": F.col("content_hash"),
        "result": F.when(is_copy, F.col("_old.result")),
        "token_usage": F.when(is_copy, F.col("_old.token_usage")),
        "cost_usd": F.when(is_copy, F.col("_old.cost_usd")),
        "processing_duration_seconds": F.when(is_copy, F.lit(0.0)),
        "attempts": F.lit(0),
        "completed_at": F.when(is_copy, now),
        "created_at": now,
        "updated_at": now,
    }
    return rows.select(
        *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
    )


def insert_if_inactive(candidates: DataFrame, jobs: DataFrame) -> DataFrame:
    """Candidates that may become active: first per content, and no active job of the same content yet."""
    keys = ["owner_id", "content_hash"]
    chosen = candidates.groupBy(*keys).agg(F.min(F.struct("created_at", "id")).alias("_first"))
    active = jobs.where(F.col("status").isin(fixed.LIVE_STATUSES) & F.col("content_hash").isNotNull())
    free = chosen.join(active.select(*keys).distinct(), keys, "left_anti")
    return candidates.join(free.select(F.col("_first.id").alias("id")), "id", "left_semi")


def reuse_while_processing(jobs: DataFrame) -> DataFrame:
    """Processing jobs whose content another job of the owner has already completed."""
    running = jobs.where(F.col("status") == fixed.PROCESSING).select("id", "owner_id", "content_hash", "attempts")
    found = lookup_by_content(running, jobs, [fixed.COMPLETED])
    return found.where(F.col("hit").isNotNull() & (F.col("hit.id") != F.col("id"))).select(
        "id", "owner_id", "content_hash", "attempts", F.col("hit.id").alias("source_id")
    )


# ---------------------------------------------------------------- transitions

def claim_oldest(jobs: DataFrame, workers: int, now: Column) -> DataFrame:
    """Start the ``workers`` oldest pending jobs; the others stay as they are.

    The claimed ids are a top-k, one per free worker; the planner knows its size and picks the join.
    """
    queue = jobs.where(F.col("status") == fixed.PENDING).select("id", "created_at")
    claimed = queue.orderBy("created_at", "id").limit(workers).select("id", F.lit(True).alias("_claimed"))
    taken = F.coalesce("_claimed", F.lit(False))
    change = lambda name, value: F.when(taken, value).otherwise(F.col(name)).alias(name)
    new = {
        "status": F.lit(fixed.PROCESSING),
        "started_at": now,
        "attempts": F.col("attempts") + 1,
        "updated_at": now,
    }
    return jobs.join(claimed, "id", "left").select(
        *[change(c, new[c]) if c in new else F.col(c) for c in jobs.columns]
    )


def apply_updates(jobs: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Guarded status writes.

    ``updates(id, new_status, expected_status, expected_attempts[, result, error, token_usage, cost_usd,
    processing_duration_seconds, seq])``. A null expectation is no guard; a null value leaves the column alone. Of
    several updates of one job the last by ``seq`` counts, without ``seq`` the greatest by status and guards.
    """
    given = [c for c in updates.columns if c not in ("id", "seq")]
    order = F.col("seq") if "seq" in updates.columns else F.struct("new_status", "expected_status", "expected_attempts")
    last = updates.groupBy("id").agg(F.max_by(F.struct(*given), order).alias("_u"))
    renamed = last.select("id", *[F.col("_u")[c].alias(f"_{c}") for c in given])
    applies = (
        F.col("_new_status").isNotNull()
        & (F.col("_expected_status").isNull() | (F.col("_expected_status") == F.col("status")))
        & (F.col("_expected_attempts").isNull() | (F.col("_expected_attempts") == F.col("attempts")))
    )
    joined = jobs.join(renamed, "id", "left").withColumn("_applies", F.coalesce(applies, F.lit(False)))
    done = F.col("_new_status").isin(fixed.COMPLETED, fixed.FAILED, fixed.CANCELLED)
    new = {
        "status": F.col("_new_status"),
        "updated_at": now,
        "started_at": F.when(F.col("_new_status") == fixed.PROCESSING, now),
        "completed_at": F.when(done, now),
    }
    for name in ("result", "error", "token_usage", "cost_usd", "processing_duration_seconds"):
        if name in given:
            new[name] = F.col(f"_{name}")
    value = lambda c: F.when(F.col("_applies"), F.coalesce(new[c], F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[value(c) if c in new else F.col(c) for c in jobs.columns])


def cancel_pending(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Cancel requested jobs ``(id, viewer_id)`` that are still pending and belong to the viewer."""
    asked = requests.groupBy("id", F.col("viewer_id").alias("owner_id")).agg(F.lit(True).alias("_asked"))
    hit = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == fixed.PENDING)
    new = {"status": F.lit(fixed.CANCELLED), "completed_at": now, "updated_at": now}
    return jobs.join(asked, ["id", "owner_id"], "left").select(
        *[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns]
    )


def is_stalled(now: Column, timeout_minutes: int) -> Column:
    limit = now - F.expr(f"interval {int(timeout_minutes)} minutes")
    return F.coalesce((F.col("status") == fixed.PROCESSING) & (F.col("started_at") < limit), F.lit(False))


def recover_stalled(
    jobs: DataFrame,
    now: Column,
    timeout_minutes: int = fixed.STALL_TIMEOUT_MINUTES,
    max_attempts: int = fixed.MAX_ATTEMPTS,
) -> DataFrame:
    """Put stalled jobs back in the queue, or fail them once their attempts are used up."""
    stalled = is_stalled(now, timeout_minutes)
    spent = stalled & (F.col("attempts") >= max_attempts)
    message = fixed.STALL_MESSAGE.format(max_attempts)
    new = {
        "status": F.when(spent, fixed.FAILED).when(stalled, fixed.PENDING).otherwise(F.col("status")),
        "error": F.when(spent, message).otherwise(F.col("error")),
        "completed_at": F.when(spent, now).otherwise(F.col("completed_at")),
        "updated_at": F.when(stalled, now).otherwise(F.col("updated_at")),
    }
    return jobs.select(*[new[c].alias(c) if c in new else F.col(c) for c in jobs.columns])


def count_stalled(jobs: DataFrame, now: Column, timeout_minutes: int = fixed.STALL_TIMEOUT_MINUTES) -> DataFrame:
    return jobs.agg(F.count_if(is_stalled(now, timeout_minutes)).alias("recovered"))


def active_sessions(sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """Sessions that have not expired, with their user."""
    live = sessions.where(F.col("expires_at") > now).select("token", "user_id")
    return live.join(users.select("user_id", "email", "name"), "user_id")


def session_lookup(tokens: DataFrame, sessions: DataFrame, users: DataFrame, now: Column) -> DataFrame:
    """The live session and its user for each asked ``token``; unknown and expired tokens give nothing."""
    asked = tokens.select("token").distinct()
    return active_sessions(sessions.join(asked, "token", "left_semi"), users, now)
