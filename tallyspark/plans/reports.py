"""Queries of the records report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.functions.money import usd
from tallyspark.operators import report as ops, rules
from tallyspark.plans.oracle_tables import RECORDS, REPORT, JOBS, with_tables
from tallyspark.plans.registry import as_double, joined, query
from tallyspark.schema import MONEY_COLUMNS
from tallyspark.sources import warehouse

MONEY_SQL = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in MONEY_COLUMNS)
ZERO_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS DOUBLE) AS {c}" for c in MONEY_COLUMNS)
NULL_SUMS = ", ".join(f"CAST(sum({c}) AS DOUBLE) AS {c}" for c in MONEY_COLUMNS)
CODES_SQL = "code || CASE WHEN n > 1 THEN '|36415,59' ELSE '' END"


def report_rows(spark, folder):
    return ops.flatten_report(warehouse.jobs(spark, folder))


def _scalars(rows):
    return rows.select(
        "row_id", "job_id", "owner_id", "idx", "source_file", "invoice_number", "treatment_date",
        F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        joined("cpt_codes"), "description", "provider", joined("payers"), *as_double(*MONEY_COLUMNS), "page",
        "needs_review", joined("review_reasons"),
    )


SCALARS_SQL = f"""SELECT job_id || ':' || idx AS row_id, job_id, owner_id, CAST(idx AS INTEGER) AS idx, source_file,
  invoice_number, treatment_date, CAST(start_date AS VARCHAR) AS start_date, CAST(end_date AS VARCHAR) AS end_date,
  {CODES_SQL} AS cpt_codes, description, provider, array_to_string(payers, '|') AS payers, {MONEY_SQL}, page,
  needs_review, review_reasons FROM report"""


@query("flat_report", with_tables(REPORT, SCALARS_SQL))
def flat_report(spark, folder):
    """Every record of every completed job with its payers, dates and review status."""
    return _scalars(report_rows(spark, folder))


@query("report_totals", with_tables(REPORT, f"SELECT count(*) AS records, {ZERO_SUMS} FROM report"))
def report_totals(spark, folder):
    totals = ops.report_totals(report_rows(spark, folder))
    return totals.select("records", *as_double(*MONEY_COLUMNS))


@query(
    "owner_totals",
    with_tables(REPORT, f"SELECT owner_id, count(*) AS records, {ZERO_SUMS} FROM report GROUP BY owner_id"),
)
def owner_totals(spark, folder):
    totals = ops.report_totals(report_rows(spark, folder), "owner_id")
    return totals.select("owner_id", "records", *as_double(*MONEY_COLUMNS))


@query(
    "job_totals",
    with_tables(REPORT, f"SELECT job_id, count(*) AS records, {NULL_SUMS} FROM report GROUP BY job_id"),
)
def job_totals(spark, folder):
    return ops.job_totals(report_rows(spark, folder)).select("job_id", "records", *as_double(*MONEY_COLUMNS))


SEARCH_SQL = f"""lower(concat_ws(' ', source_file, coalesce(invoice_number, 'Invoice not found'), provider,
  coalesce(description, ''), page, replace({CODES_SQL}, '|', ' '), array_to_string(payers, ' ')))"""


@query("report_search", with_tables(REPORT, SCALARS_SQL + f" WHERE contains({SEARCH_SQL}, 'not found')"))
def report_search(spark, folder):
    """Free text over all shown fields: rows whose invoice was not found."""
    return _scalars(ops.filter_report(report_rows(spark, folder), ops.ReportFilters(query="  NOT found ")))


@query(
    "report_filtered",
    with_tables(
        REPORT,
        SCALARS_SQL + """ WHERE list_contains(payers, 'Payer 3') AND NOT needs_review AND balance IS NOT NULL
  AND balance <> 0 AND end_date >= DATE '1996-02-01' AND start_date <= DATE '1999-12-31'""",
    ),
)
def report_filtered(spark, folder):
    """Payer, review state, open balance and a date window that treatments must overlap."""
    chosen = ops.ReportFilters(
        payer="Payer 3", review="clean", financial="has_balance", date_from="1996-02-01", date_to="1999-12-31"
    )
    return _scalars(ops.filter_report(report_rows(spark, folder), chosen))


@query(
    "report_missing_invoice",
    with_tables(
        REPORT,
        SCALARS_SQL + " WHERE invoice_number IS NULL AND needs_review AND total_charges <> 0 AND provider = 'Supplier#000000003'",
    ),
)
def report_missing_invoice(spark, folder):
    chosen = ops.ReportFilters(
        provider="Supplier#000000003", invoice="__missing_invoice__", review="needs_review", financial="has_charges"
    )
    return _scalars(ops.filter_report(report_rows(spark, folder), chosen))


@query(
    "report_facets",
    with_tables(
        REPORT,
        """SELECT 'provider' AS facet, provider AS value, provider AS label FROM report GROUP BY provider
UNION ALL SELECT 'invoice', coalesce(invoice_number, '__missing_invoice__'),
  coalesce(invoice_number, 'Invoice not found') FROM report GROUP BY invoice_number
UNION ALL SELECT 'payer', p, p FROM (SELECT DISTINCT unnest(payers) AS p FROM report)""",
    ),
)
def report_facets(spark, folder):
    return ops.report_facets(report_rows(spark, folder))


@query(
    "invoice_groups",
    with_tables(
        REPORT,
        f"""SELECT job_id, CAST(row_number() OVER (PARTITION BY job_id ORDER BY first_idx) - 1 AS INTEGER) AS group_no,
  invoice_number, coalesce('Invoice ' || invoice_number, 'Invoice not found') AS label,
  CAST(first_idx AS INTEGER) AS first_idx, records, record_idx, {', '.join(MONEY_COLUMNS)} FROM (
  SELECT job_id, invoice_number, min(idx) AS first_idx, count(*) AS records,
    string_agg(CAST(idx AS VARCHAR), '|' ORDER BY idx) AS record_idx, {NULL_SUMS}
  FROM report GROUP BY job_id, invoice_number)""",
    ),
)
def invoice_groups(spark, folder):
    groups = ops.invoice_groups(report_rows(spark, folder))
    return groups.select(
        "job_id", "group_no", "invoice_number", "label", "first_idx", "records", joined("record_idx"),
        *as_double(*MONEY_COLUMNS),
    )


def _page_sql(page: str) -> str:
    """SQL of one page of the report, ``page`` being what asks for it; the rank shows the order."""
    return with_tables(
        REPORT
        + f""", pager AS (SELECT greatest(1, CAST(ceil(count(*) / 50.0) AS INTEGER)) AS page_count FROM report),
  placed AS (SELECT *, CAST(row_number() OVER (ORDER BY job_id, idx) AS INTEGER) AS row_no FROM report),
  asked AS (SELECT page_count, {page} AS page_no FROM pager)""",
        """
SELECT job_id, CAST(idx AS INTEGER) AS idx, provider, CAST(total_charges AS DOUBLE) AS total_charges,
  row_no, page_no, page_count
FROM placed, asked WHERE row_no > (page_no - 1) * 50 AND row_no <= page_no * 50""",
    )


def _page(spark, folder, page: int):
    rows = report_rows(spark, folder).select("job_id", "idx", "provider", "total_charges")
    return ops.report_page(rows, page).select(
        "job_id", "idx", "provider", *as_double("total_charges"), "row_no", "page_no", "page_count"
    )


@query("report_page", _page_sql("least(3, page_count)"))
def report_page(spark, folder):
    """The third page of the report, fifty rows each."""
    return _page(spark, folder, 3)


@query("report_last_page", _page_sql("page_count"))
def report_last_page(spark, folder):
    """The last page of the report, asked for by a number beyond it."""
    return _page(spark, folder, 1_000_000_000)


CARDS = RECORDS + ", " + JOBS + """, counted AS (
  SELECT k, count(*) AS records, count(DISTINCT coalesce(invoice_number, '-')) AS invoices,
    count(*) FILTER (WHERE qty > 45) AS flagged FROM recs GROUP BY k), cards AS (
  SELECT j.id AS job_id, j.owner_id, j.status, 'source-' || j.k || '.pdf' AS source_file,
    CAST(CASE WHEN j.status IN ('completed','failed') THEN coalesce(c.records, 0) ELSE 0 END AS INTEGER) AS records,
    CAST(CASE WHEN j.status IN ('completed','failed') THEN coalesce(c.invoices, 0) ELSE 0 END AS INTEGER) AS invoices,
    CAST(CASE WHEN j.status IN ('completed','failed') THEN coalesce(c.flagged, 0)
      + CASE WHEN j.priority = '1-URGENT' THEN 1 ELSE 0 END ELSE 0 END AS INTEGER) AS flagged,
    j.status = 'completed' AND j.k % 900 = 0 OR j.status = 'completed' AND j.k % 5 = 0 AS cached,
    j.status IN ('pending','processing') AS live
  FROM jobs j LEFT JOIN counted c ON j.k = c.k)"""


@query("job_cards", with_tables(CARDS, "SELECT * FROM cards"))
def job_cards(spark, folder):
    return ops.job_cards(warehouse.jobs(spark, folder))


@query(
    "document_list",
    with_tables(CARDS, "SELECT * FROM cards WHERE status = 'completed' AND flagged > 0 AND contains(source_file, '-12')"),
)
def document_list(spark, folder):
    """Completed documents with flags whose file name holds ``-12``."""
    cards = ops.job_cards(warehouse.jobs(spark, folder))
    return ops.filter_cards(cards, status="completed", file_query=" -12", flagged_only=True)


@query(
    "money_labels",
    with_tables(
        REPORT,
        """SELECT job_id, CAST(idx AS INTEGER) AS idx,
  coalesce(CASE WHEN payments < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(CAST(payments AS DOUBLE))), '—') AS paid,
  CASE WHEN balance < 0 THEN '-$' ELSE '$' END || format('{:,.2f}', abs(CAST(balance AS DOUBLE))) AS open
FROM report""",
    ),
)
def money_labels(spark, folder):
    rows = report_rows(spark, folder)
    return rows.select("job_id", "idx", usd(F.col("payments")).alias("paid"), usd(F.col("balance")).alias("open"))


@query(
    "review_severity",
    with_tables(
        REPORT + """, missing AS (SELECT CAST(total_charges IS NULL AS INTEGER) + CAST(ins_paid IS NULL AS INTEGER)
  + CAST(adjustment IS NULL AS INTEGER) + CAST(payments IS NULL AS INTEGER) + CAST(balance IS NULL AS INTEGER) AS m
  FROM report)""",
        """SELECT CASE WHEN m >= 4 THEN 'high' WHEN m >= 2 THEN 'medium' WHEN m = 1 THEN 'low' END AS severity,
  count(*) AS records FROM missing GROUP BY 1""",
    ),
)
def review_severity(spark, folder):
    rows = rules.with_review_severity(report_rows(spark, folder))
    return rows.groupBy("severity").agg(F.count(F.lit(1)).alias("records"))


@query(
    "codes_on_ranges",
    with_tables(
        REPORT,
        """SELECT provider, count(*) FILTER (WHERE start_date <> end_date) AS ranges_with_codes, count(*) AS records
FROM report GROUP BY provider""",
    ),
)
def codes_on_ranges(spark, folder):
    """Per provider, the multi-day records that list codes against the rules."""
    bad = rules.codes_on_range(F.col("start_date"), F.col("end_date"), F.col("cpt_codes"))
    return report_rows(spark, folder).groupBy("provider").agg(
        F.count_if(bad).alias("ranges_with_codes"), F.count(F.lit(1)).alias("records")
    )
