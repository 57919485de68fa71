"""Queries that score predictions against ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.operators import evaluation as ops
from tallyspark.plans.oracle_tables import RECORDS, with_tables
from tallyspark.plans.registry import query
from tallyspark.session import new_folder
from tallyspark.sources import files, warehouse

# Truth and prediction pair up by position; dropping the first record moves all later ones up.
_PAIRED = RECORDS + """, truth AS (
  SELECT k, idx AS pos, treatment_date, code || n AS codes, description, provider, insurer, partner, partner2,
    total_charges, ins_paid, adjustment, payments, balance, page, n > 1 AS more FROM recs), predicted AS (
  SELECT k, CASE WHEN k % 7 = 0 THEN idx - 1 ELSE idx END AS pos, treatment_date,
    code, n > 1 AS more, description, CASE WHEN k % 5 = 0 THEN provider || ' X' ELSE provider END AS provider, insurer,
    partner, partner2, total_charges, ins_paid, adjustment, payments, balance,
    CASE WHEN k % 4 <> 0 THEN page END AS page FROM recs WHERE k % 11 <> 0 AND NOT (k % 7 = 0 AND idx = 0)), pairs AS (
  SELECT coalesce(t.k, p.k) AS k, coalesce(t.pos, p.pos) AS pos, t.k IS NOT NULL AND p.k IS NOT NULL AS b,
    t.treatment_date IS NOT DISTINCT FROM p.treatment_date AS m1,
    left(t.codes, 5) IS NOT DISTINCT FROM p.code AND t.more IS NOT DISTINCT FROM p.more AS m2,
    t.description IS NOT DISTINCT FROM p.description AS m3, t.provider IS NOT DISTINCT FROM p.provider AS m4,
    t.insurer IS NOT DISTINCT FROM p.insurer AS m5,
    t.partner IS NOT DISTINCT FROM p.partner AND t.partner2 IS NOT DISTINCT FROM p.partner2 AS m6,
    t.total_charges IS NOT DISTINCT FROM p.total_charges AS m7, t.ins_paid IS NOT DISTINCT FROM p.ins_paid AS m8,
    t.adjustment IS NOT DISTINCT FROM p.adjustment AS m9, t.payments IS NOT DISTINCT FROM p.payments AS m10,
    t.balance IS NOT DISTINCT FROM p.balance AS m11, t.page IS NOT DISTINCT FROM p.page AS m12
  FROM truth t FULL JOIN predicted p ON t.k = p.k AND t.pos = p.pos)"""

_LONG = _PAIRED + ", long AS (" + " UNION ALL ".join(
    f"SELECT k, '{name}' AS field, CAST(b AND m{i} AS INTEGER) AS hit FROM pairs"
    for i, (name, _) in enumerate(fixed.SCORED_FIELDS, 1)
) + ")"


@query(
    "field_accuracy",
    with_tables(
        _LONG,
        """SELECT CASE WHEN GROUPING(field) = 1 AND GROUPING(k) = 1 THEN 'overall' WHEN GROUPING(k) = 1 THEN 'field'
    ELSE 'document' END AS grain,
  CASE WHEN GROUPING(k) = 0 THEN 'job-' || k END AS doc_id, field, CAST(sum(hit) AS BIGINT) AS matched,
  count(*) AS total, round_even(sum(hit) / count(*), 4) AS accuracy
FROM long GROUP BY GROUPING SETS ((), (field), (k))""",
    ),
)
def field_accuracy(spark, folder):
    truth, found = warehouse.ground_truth(spark, folder), warehouse.predictions(spark, folder)
    return ops.accuracy(ops.field_matches(truth.select("doc_id", "records"), found))


@query(
    "document_scores",
    with_tables(
        _LONG,
        """, sizes AS (SELECT k, count(*) AS n FROM recs GROUP BY k)
SELECT 'job-' || l.k AS doc_id, CASE WHEN l.k % 11 = 0 THEN 'missing_prediction' ELSE 'scored' END AS status,
  any_value(s.n) AS records_expected,
  CASE WHEN l.k % 11 = 0 THEN 0 WHEN l.k % 7 = 0 THEN any_value(s.n) - 1 ELSE any_value(s.n) END AS records_predicted,
  round_even(sum(hit) / count(*), 4) AS field_accuracy
FROM long l JOIN sizes s ON l.k = s.k GROUP BY l.k""",
    ).replace("\n, sizes", ", sizes"),
)
def document_scores(spark, folder):
    truth, found = warehouse.ground_truth(spark, folder), warehouse.predictions(spark, folder)
    return ops.document_scores(truth.select("doc_id", "records"), found)


@query(
    "duplicate_truth",
    """SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, count(*) AS copies FROM lineitem
GROUP BY l_suppkey HAVING count(*) > 1""",
)
def duplicate_truth(spark, folder):
    """Document ids that occur more than once; suppliers of line items stand for them."""
    rows = warehouse.table(spark, folder, "lineitem").select(F.col("l_suppkey").cast("string").alias("doc_id"))
    return ops.duplicate_documents(rows)


@query(
    "written_report",
    """SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, count(*) AS copies FROM lineitem
GROUP BY l_suppkey HAVING count(*) > 1""",
)
def written_report(spark, folder):
    """The report of documents that occur more than once, written as JSON lines and read back."""
    report, path = duplicate_truth(spark, folder), new_folder(spark, "report")
    files.write_report(report, path)
    return spark.read.schema(report.schema).json(path)
