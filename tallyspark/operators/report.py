"""The records report: flatten results, attach flags, filter, facet, group and total."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark import fixed
from tallyspark.functions.dates import treatment_span
from tallyspark.functions.invoices import (
    invoice_filter_value, invoice_heading, invoice_option_label, normal_invoice,
)
from tallyspark.functions.money import has_money, totals_or_null, totals_or_zero
from tallyspark.functions.text import file_name
from tallyspark.operators.paging import Places
from tallyspark.schema import MONEY_COLUMNS
from tallyspark.session import stored


@dataclass(frozen=True)
class ReportFilters:
    """Report filters; an empty value filters nothing. Dates are ``YYYY-MM-DD``."""

    query: str = ""
    provider: str = ""
    invoice: str = ""
    payer: str = ""
    review: str = "all"  # all, needs_review, clean
    financial: str = "all"  # all, has_balance, has_charges
    date_from: str = ""
    date_to: str = ""


def _payers(record: Column) -> Column:
    both = F.concat(
        F.coalesce(record["insurers"], F.array()), F.coalesce(record["third_parties"], F.array())
    )
    return F.array_distinct(F.filter(both, lambda p: p.isNotNull() & (p != "")))


def flatten_report(jobs: DataFrame) -> DataFrame:
    """One row per record of every completed job, with its review status.

    Flags without a row number belong to every record of their document and come first.
    """
    # the outer form, filtered afterwards: the plain one makes the planner evaluate the result a second time
    rows = (
        jobs.where(F.col("status") == fixed.COMPLETED)
        .select(
            F.col("id").alias("job_id"),
            "owner_id",
            "pdf_path",
            F.coalesce(F.col("result.flagged"), F.array()).alias("_flags"),
            F.posexplode_outer("result.records").alias("idx", "_r"),
        )
        .where(F.col("idx").isNotNull())
    )
    flags = F.concat(
        F.filter("_flags", lambda f: f["row"].isNull()),
        F.filter("_flags", lambda f: f["row"] == F.col("idx")),
    )
    record = F.col("_r")
    span = rows.withColumn("_span", treatment_span(record["treatment_date"])).withColumn("_flags", flags)
    return span.select(
        F.concat_ws(":", "job_id", F.col("idx").cast("string")).alias("row_id"),
        "job_id",
        "owner_id",
        "idx",
        file_name(F.col("pdf_path")).alias("source_file"),
        normal_invoice(record["invoice_number"]).alias("invoice_number"),
        record["treatment_date"].alias("treatment_date"),
        F.col("_span.start_date").alias("start_date"),
        F.col("_span.end_date").alias("end_date"),
        *[record[c].alias(c) for c in ("cpt_codes", "description", "provider", "insurers", "third_parties")],
        _payers(record).alias("payers"),
        *[record[c].alias(c) for c in MONEY_COLUMNS],
        record["page"].alias("page"),
        (F.size("_flags") > 0).alias("needs_review"),
        F.transform("_flags", lambda f: f["reason"]).alias("review_reasons"),
    )


def search_text() -> Column:
    """The text a free query looks into, lower-cased."""
    blank = lambda name: F.coalesce(F.col(name), F.lit(""))
    return F.lower(
        F.concat_ws(
            " ",
            blank("source_file"),
            F.coalesce("invoice_number", F.lit(fixed.MISSING_INVOICE_LABEL)),
            blank("provider"),
            blank("description"),
            blank("page"),
            F.array_join("cpt_codes", " "),
            F.array_join("payers", " "),
        )
    )


def filter_report(rows: DataFrame, filters: ReportFilters) -> DataFrame:
    """Rows that meet every given filter; undated rows go once a date bound is set."""
    tests: list[Column] = []
    query = filters.query.strip().lower()
    if query:
        tests.append(search_text().contains(query))
    if filters.provider:
        tests.append(F.col("provider") == filters.provider)
    if filters.invoice:
        tests.append(invoice_filter_value(F.col("invoice_number")) == filters.invoice)
    if filters.payer:
        tests.append(F.array_contains("payers", filters.payer))
    if filters.review == "needs_review":
        tests.append(F.col("needs_review"))
    elif filters.review == "clean":
        tests.append(~F.col("needs_review"))
    if filters.financial == "has_balance":
        tests.append(has_money(F.col("balance")))
    elif filters.financial == "has_charges":
        tests.append(has_money(F.col("total_charges")))
    if filters.date_from or filters.date_to:
        tests.append(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    if filters.date_from:
        tests.append(F.col("end_date") >= F.lit(filters.date_from).cast("date"))
    if filters.date_to:
        tests.append(F.col("start_date") <= F.lit(filters.date_to).cast("date"))
    return reduce(DataFrame.where, tests, rows)


def report_totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Record count and five totals; a missing amount counts as zero."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), *totals_or_zero())


def report_facets(rows: DataFrame) -> DataFrame:
    """Distinct filter options ``(facet, value, label)`` in label order within each facet."""
    option = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    options = F.concat(
        F.array(
            option("provider", F.col("provider")),
            option("invoice", invoice_filter_value(F.col("invoice_number"))),
        ),
        F.transform("payers", lambda p: option("payer", p)),
    )
    found = rows.select(F.inline(options)).where(F.col("value") != "").distinct()
    label = F.when(F.col("facet") == "invoice", invoice_option_label(F.col("value"))).otherwise(F.col("value"))
    return found.select("facet", "value", label.alias("label")).orderBy(
        "facet", F.collate(F.col("label"), "UNICODE"), "value"
    )


def invoice_groups(rows: DataFrame) -> DataFrame:
    """Records of each job grouped by invoice, groups numbered in first-seen order.

    A total is null when none of its amounts is known. ``group_no`` ranks the groups of one job, which are at
    most as many as the records of one document.
    """
    grouped = rows.groupBy("job_id", "invoice_number").agg(
        F.min("idx").alias("first_idx"),
        F.count(F.lit(1)).alias("records"),
        F.sort_array(F.collect_list("idx")).alias("record_idx"),
        *totals_or_null(),
    )
    order = Window.partitionBy("job_id").orderBy("first_idx")
    return grouped.select(
        "job_id",
        (F.row_number().over(order) - 1).alias("group_no"),
        "invoice_number",
        invoice_heading(F.col("invoice_number")).alias("label"),
        "first_idx",
        "records",
        "record_idx",
        *MONEY_COLUMNS,
    )


def job_totals(rows: DataFrame) -> DataFrame:
    """Financial summary per document, null where no amount is known."""
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("records"), *totals_or_null())


def report_page(rows: DataFrame, page: int, page_rows: int = fixed.REPORT_PAGE_ROWS) -> DataFrame:
    """One page of the report in job and record order, the page number kept within what exists.

    The rows are stored: dealing their keys into ranges, counting them and reading the page would each make them again.
    """
    rows = stored(rows, "report")
    places = Places(rows, {"job_id": False, "idx": False})
    pages = max(1, -(-places.total // page_rows))
    page = min(max(1, page), pages)
    first = (page - 1) * page_rows
    shown = places.from_place(rows, first, page_rows)
    # a page's rows are few, so numbering them needs no partitions
    number = F.row_number().over(Window.orderBy("job_id", "idx")) + first
    return shown.withColumns({"row_no": number, "page_no": F.lit(page), "page_count": F.lit(pages)})


def job_cards(jobs: DataFrame) -> DataFrame:
    """What a document list shows per job: file, counts, cache mark, liveness."""
    records = F.coalesce(F.col("result.records"), F.array())
    invoices = F.transform(records, lambda r: invoice_filter_value(normal_invoice(r["invoice_number"])))
    return jobs.select(
        F.col("id").alias("job_id"),
        "owner_id",
        "status",
        file_name(F.col("pdf_path")).alias("source_file"),
        F.size(records).alias("records"),
        F.size(F.array_distinct(invoices)).alias("invoices"),
        F.coalesce(F.size("result.flagged"), F.lit(0)).alias("flagged"),
        F.coalesce(
            (F.col("status") == fixed.COMPLETED) & (F.col("processing_duration_seconds") == 0), F.lit(False)
        ).alias("cached"),
        F.col("status").isin(fixed.LIVE_STATUSES).alias("live"),
    )


def filter_cards(
    cards: DataFrame, status: str | None = None, file_query: str = "", flagged_only: bool = False
) -> DataFrame:
    """Document list filters: status, part of the file name, at least one flag."""
    if status:
        cards = cards.where(F.col("status") == status)
    needle = file_query.strip().lower()
    if needle:
        cards = cards.where(F.lower("source_file").contains(needle))
    return cards.where(F.col("flagged") > 0) if flagged_only else cards
