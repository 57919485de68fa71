"""Job table operators on small tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions.text import error_text
from tallyspark.operators import jobs as ops


def now():
    return F.lit("2026-01-02 00:00:00").cast("timestamp")


COLUMNS = (
    "id string, owner_id string, status string, content_hash string, result string, error string, attempts int, "
    "started_at timestamp, completed_at timestamp, created_at timestamp, updated_at timestamp"
)


def at(minute):
    return datetime.datetime(2026, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


def job(job_id, owner="alice", status="pending", content=None, result=None, attempts=0, started=None, created=0):
    return (job_id, owner, status, content, result, None, attempts, started, None, at(created), at(created))


def table(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def amounts(*pairs):
    body = ",".join(f'{{"total_charges": {c}, "balance": {b}}}' for c, b in pairs)
    return body


def test_summary_per_owner(spark):
    frame = table(
        spark,
        job("1", status="completed", result=f'{{"records": [{amounts((100, 10), (200, 20))}], "flagged": [{{"row": 0}}]}}'),
        job("2", status="completed", result=f'{{"records": [{amounts((50, 5))}], "flagged": []}}'),
        job("3"),
        job("4", "bob", "completed", result=f'{{"records": [{amounts((999, 999))}]}}'),
    )
    row = ops.summary(ops.owner_scope(frame, "alice")).first()
    assert (row["total"], row["completed"], row["pending"], row["records_count"], row["flagged_count"]) == (3, 2, 1, 3, 1)
    assert (row["total_charges"], row["balance"]) == (350.0, 35.0)
    empty = ops.summary(ops.owner_scope(frame, None)).first()
    assert (empty["total"], empty["records_count"], empty["total_charges"]) == (0, 0, 0.0)


def test_malformed_money_and_results(spark):
    rows = amounts((100, 10), ('"N/A"', '"oops"'), ('"NaN"', 0), ('" 50.00 "', '"-5"'), ('"1e3"', "null"))
    frame = table(
        spark,
        job("1", status="completed", result=f'{{"records": [{rows}]}}'),
        job("2", status="completed", result='{"records": "none", "flagged": {}}'),
        job("3", status="completed", result="not json"),
        job("4", status="failed", result=f'{{"records": [{amounts((7, 7))}, 3]}}'),
    )
    row = ops.summary(frame).first()
    assert (row["records_count"], row["flagged_count"]) == (7, 0)
    assert (row["total_charges"], row["balance"]) == (150.0, 5.0)


def test_keyset_pages_survive_new_rows(spark):
    frame = table(spark, *[job(f"j{i}", created=100 - i) for i in range(5)])
    first = [r["id"] for r in ops.list_jobs(frame, limit=2).collect()]
    frame = frame.unionByName(table(spark, job("new", created=500)))
    pages, cursor = [first], first
    while len(cursor) == 2:
        last = frame.where(F.col("id") == cursor[-1]).first()
        cursor = [r["id"] for r in ops.list_jobs(frame, limit=2, before=(str(last["created_at"]), last["id"])).collect()]
        pages.append(cursor)
    assert pages == [["j0", "j1"], ["j2", "j3"], ["j4"]]
    with pytest.raises(ValueError):
        ops.list_jobs(frame, before=("2026-01-01", None))
    with pytest.raises(ValueError):
        ops.list_jobs(frame, limit=201)


def test_writes_need_the_owner(spark):
    frame = table(spark, job("1"), job("2", "bob"))
    assert [r["accepted"] for r in ops.check_owner(frame, F.lit("alice")).orderBy("id").collect()] == [True, False]
    assert [r["accepted"] for r in ops.check_owner(frame, F.lit(None)).collect()] == [False, False]
    assert ops.require_owner(frame.where("id = '1'"), "alice").count() == 1
    with pytest.raises(Exception, match="row of another owner: bob"):
        ops.require_owner(frame, "alice").collect()


def test_claim_and_recover(spark):
    frame = table(spark, *[job(f"j{i}", created=i) for i in range(5)])
    taken = ops.claim_oldest(frame, 8, now())
    assert [(r["status"], r["attempts"]) for r in taken.collect()] == [("processing", 1)] * 5
    assert ops.claim_oldest(frame, 2, now()).where("status = 'processing'").count() == 2

    old, fresh = datetime.datetime(2026, 1, 1, 23, 50), datetime.datetime(2026, 1, 1, 23, 59)
    stuck = table(
        spark, job("again", status="processing", attempts=1, started=old),
        job("spent", status="processing", attempts=3, started=old), job("busy", status="processing", started=fresh),
    )
    after = {r["id"]: r for r in ops.recover_stalled(stuck, now(), 5, 3).collect()}
    assert {k: r["status"] for k, r in after.items()} == {"again": "pending", "spent": "failed", "busy": "processing"}
    assert after["spent"]["error"].endswith("max attempts (3) exhausted")
    assert ops.count_stalled(stuck, now(), 5).first()[0] == 2


def test_stale_write_changes_nothing(spark):
    frame = table(spark, job("1", status="processing", attempts=1), job("2", status="processing", attempts=2))
    updates = spark.createDataFrame(
        [("1", "completed", "processing", 99, "x"), ("2", "completed", "processing", 2, None)],
        "id string, new_status string, expected_status string, expected_attempts int, error string",
    )
    after = {r["id"]: r for r in ops.apply_updates(frame, updates, now()).collect()}
    assert (after["1"]["status"], after["1"]["completed_at"]) == ("processing", None)
    assert (after["2"]["status"], after["2"]["error"]) == ("completed", None)
    assert after["2"]["completed_at"] is not None


def test_submissions(spark):
    frame = table(
        spark, job("old", status="completed", content="h", created=1), job("new", status="completed", content="h", created=2),
        job("run", status="processing", content="r"), job("theirs", "bob", "completed", "b"),
    )
    asked = spark.createDataFrame(
        [
            ("1", "alice", "h", at(1), False), ("2", "alice", "h", at(2), True), ("3", "alice", "h", at(3), True),
            ("4", "alice", "r", at(1), True), ("5", "alice", "b", at(1), False), ("6", "alice", "b", at(0), False),
            ("7", "alice", None, at(1), False), ("8", "alice", None, at(1), False),
        ],
        "request_id string, owner_id string, content_hash string, submitted_at timestamp, bypass boolean",
    )
    found = {r["request_id"]: (r["outcome"], r["target_id"]) for r in ops.resolve_submissions(asked, frame).collect()}
    assert found == {
        "1": ("cached", "new"), "2": ("created", "2"), "3": ("joined", "2"), "4": ("joined", "run"),
        "5": ("joined", "6"), "6": ("created", "6"), "7": ("created", "7"), "8": ("created", "8"),
    }


def test_error_text_hides_paths_and_is_cut(spark):
    frame = spark.createDataFrame([("/app/pdfs/u/x.pdf missing",), ("y" * 600,)], "m string")
    shown = [r[0] for r in frame.select(error_text(F.lit("ValueError"), F.col("m"), "/app/pdfs")).collect()]
    assert shown[0] == "ValueError: <pdf-volume>/u/x.pdf missing"
    assert len(shown[1]) == 500 and shown[1].endswith("…")
