"""Extraction queries: orders printed as ledger documents and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import extraction as ops
from tallyspark.operators.rules import prefer_ledger, prefer_summary
from tallyspark.operators.segments import document_facts, segments_of
from tallyspark.plans.oracle_tables import ORDER_TOTALS, with_tables
from tallyspark.plans.registry import as_double, joined, query
from tallyspark.schema import MONEY_COLUMNS
from tallyspark.session import new_folder
from tallyspark.sources import files, warehouse


def _pages(spark, folder, layout=None):
    """The printed ledgers as page files in the shared folder, read back."""
    path = new_folder(spark, "pages")
    warehouse.ledger_pages(spark, folder, layout).write.parquet(path)
    return files.read_pages(spark, path)


def _records(spark, folder, layout):
    return ops.extract_records(_pages(spark, folder, layout))


def _scalars(records):
    return records.select(
        "doc_id", "layout", "idx", "invoice_number", "treatment_date", joined("cpt_codes"), "description",
        "provider", joined("insurers"), joined("third_parties"), *as_double(*MONEY_COLUMNS), "page",
    )


def _sql(layout, invoice="NULL", date="d1 || ' - ' || d2", codes="''", description="NULL", provider="''", insurers="''"):
    return f"""SELECT CAST(doc AS VARCHAR) AS doc_id, '{layout}' AS layout, CAST(idx AS INTEGER) AS idx,
  {invoice} AS invoice_number, {date} AS treatment_date, {codes} AS cpt_codes, {description} AS description,
  '{provider}' AS provider, {insurers} AS insurers, '' AS third_parties, CAST(total AS DOUBLE) AS total_charges,
  CAST(paid AS DOUBLE) AS ins_paid, CAST(adj AS DOUBLE) AS adjustment, CAST(NULL AS DOUBLE) AS payments,
  CAST(open AS DOUBLE) AS balance, pages AS page"""


# The payer named most often in a document (at least twice and by a quarter of the claims, the first seen on a
# tie) replaces the other payer that shares words with it.
_CLAIM_PAYERS = ORDER_TOTALS + """, named AS (
  SELECT *, CASE part % 5 WHEN 0 THEN 'Quartz Meadow Health' WHEN 1 THEN 'Quartz Meadow Plan' WHEN 2 THEN 'Granite Mutual'
    WHEN 3 THEN 'Harbor Life' ELSE 'Insurance Payment' END AS payer FROM ledger), votes AS (
  SELECT doc, payer, count(*) AS n, min(idx) AS first_idx FROM named WHERE part % 5 <> 4 GROUP BY doc, payer),
  top AS (SELECT doc, payer AS top_payer, n AS top_n FROM (
    SELECT *, row_number() OVER (PARTITION BY doc ORDER BY n DESC, first_idx) AS rn FROM votes) WHERE rn = 1),
  sizes AS (SELECT doc, count(*) AS claims FROM named GROUP BY doc), settled AS (
  SELECT n.*, CASE WHEN top_n >= greatest(2, claims // 4) AND left(n.payer, 6) = 'Quartz' AND left(top_payer, 6) = 'Quartz'
    THEN top_payer ELSE n.payer END AS insurer
  FROM named n JOIN sizes s ON n.doc = s.doc LEFT JOIN top t ON n.doc = t.doc)"""

CLAIMS_SQL = _sql(
    "claim", "'Claim ' || (k + 100000)", "dc", "claim_codes", provider="Alder Grove Clinic, PC", insurers="insurer"
) + " FROM settled"
ACCOUNTS_SQL = _sql(
    "account", "'Account ' || k", "d1 || ' - ' || d3", "account_codes", provider="Pinecrest Scan Partners, Inc.",
    insurers="'Lantern Bay Coverage'",
) + " FROM ledger"
ADMISSIONS_SQL = _sql(
    "admission", provider="Harrow Lane Care", insurers="'Cedar Mutual Plan'",
    description="'Condition ' || (part % 50) || ' with acute' || CASE WHEN k % 2 = 1 THEN ' exacerbation' ELSE '' END",
) + " FROM ledger"
INPATIENT_SQL = _sql(
    "inpatient", provider="Mercy Hospital", insurers="'Harbor Life'", description="'Condition ' || (part % 50) || ' with acute'"
) + " FROM ledger"
DIALYSIS_SQL = _sql(
    "dialysis", "'CLM' || k", provider="Kidney Partners", description="'Dialysis — ' || n || ' treatments'",
    insurers="""CASE WHEN part % 3 = 0 THEN '' ELSE CASE part % 4 WHEN 0 THEN 'Quartz Meadow Health'
    WHEN 1 THEN 'Quartz Meadow Plan' WHEN 2 THEN 'Granite Mutual' ELSE 'Harbor Life' END END""",
) + " FROM ledger"


@query("extract_claims", with_tables(_CLAIM_PAYERS, CLAIMS_SQL))
def extract_claims(spark, folder):
    return _scalars(_records(spark, folder, "claim"))


# All orders as one document whose page numbers have gaps; a claim on two pages names both.
_LONG = _CLAIM_PAYERS.replace("k // 8 AS doc", "0 AS doc").replace("PARTITION BY k // 8", "PARTITION BY 0").replace(
    "(k % 8) // 3 + 2 AS INTEGER", "k // 8 * 16 + (k % 8) // 3 + 2 AS INTEGER"
)


@query("extract_long_document", with_tables(_LONG, CLAIMS_SQL.replace("CAST(doc AS VARCHAR)", "'all'")))
def extract_long_document(spark, folder):
    """All claims of all orders as one document, sixteen page numbers apart; the first heading stands for all."""
    pages = _pages(spark, folder, "claim")
    document = F.col("doc_id").cast("int")
    first = pages.agg(F.min(document).alias("first"))
    kept = (F.col("page_num") > 1) | (document == F.col("first"))
    one = pages.join(F.broadcast(first), kept)  # one row: the least document
    number = (document * 16 + F.col("page_num")).cast("int")
    return _scalars(ops.extract_records(one.select(F.lit("all").alias("doc_id"), number.alias("page_num"), "page_content")))


@query("extract_accounts", with_tables(ORDER_TOTALS, ACCOUNTS_SQL))
def extract_accounts(spark, folder):
    return _scalars(_records(spark, folder, "account"))


@query("extract_admissions", with_tables(ORDER_TOTALS, ADMISSIONS_SQL))
def extract_admissions(spark, folder):
    return _scalars(_records(spark, folder, "admission"))


@query("extract_inpatient", with_tables(ORDER_TOTALS, INPATIENT_SQL))
def extract_inpatient(spark, folder):
    return _scalars(_records(spark, folder, "inpatient"))


@query("extract_dialysis", with_tables(ORDER_TOTALS, DIALYSIS_SQL))
def extract_dialysis(spark, folder):
    return _scalars(_records(spark, folder, "dialysis"))


# Party names per fill in printed order; in lists of fifty and more a name must occur three times, or in three percent.
_PHARMACY = ORDER_TOTALS + """, fills AS (
  SELECT s.k // 8 AS doc, s.part % 4 AS party, row_number() OVER (PARTITION BY s.k // 8 ORDER BY s.k, s.slot) AS pos,
    s.first_ship FROM slots s), counted AS (
  SELECT doc, party, count(*) AS n, min(pos) AS pos FROM fills GROUP BY doc, party), sized AS (
  SELECT doc, count(*) AS fills, strftime(min(first_ship), '%m/%d/%Y') AS d1, strftime(max(first_ship), '%m/%d/%Y') AS d2
  FROM fills GROUP BY doc), parties AS (
  SELECT s.doc, string_agg(CASE party WHEN 0 THEN 'Corner Discount' WHEN 1 THEN 'Delta PBM' WHEN 2 THEN 'Sun Saver Card'
    ELSE 'CAREX' END, '|' ORDER BY pos) AS names
  FROM sized s JOIN counted c ON s.doc = c.doc WHERE n >= CASE WHEN fills >= 50 THEN greatest(3, floor(fills * 0.03)) ELSE 1 END GROUP BY s.doc),
  sums_of AS (SELECT doc, sum(total) AS total, sum(paid) AS paid, sum(open) AS open FROM ledger GROUP BY doc)"""


@query(
    "extract_pharmacy",
    with_tables(
        _PHARMACY,
        """SELECT CAST(d.doc AS VARCHAR) AS doc_id, 'pharmacy' AS layout, 0 AS idx, NULL AS invoice_number,
  d1 || ' - ' || d2 AS treatment_date, '' AS cpt_codes, 'Pharmacy Expense Report' AS description,
  'Juniper Street Pharmacy' AS provider, '' AS insurers, names AS third_parties, CAST(total AS DOUBLE) AS total_charges,
  CAST(paid AS DOUBLE) AS ins_paid, CAST(0 AS DOUBLE) AS adjustment, CAST(open AS DOUBLE) AS payments,
  CAST(0 AS DOUBLE) AS balance, '1-9' AS page
FROM sized d JOIN parties p ON d.doc = p.doc JOIN sums_of s ON d.doc = s.doc""",
    ),
)
def extract_pharmacy(spark, folder):
    return _scalars(_records(spark, folder, "pharmacy"))


_MIXED = ORDER_TOTALS + """, mixed AS (
  SELECT doc % 7 AS kind, doc, k, total FROM ledger), units AS (
  SELECT kind, doc, total FROM mixed WHERE kind < 5
  UNION ALL SELECT kind, doc, sum(total) FROM mixed WHERE kind = 5 GROUP BY kind, doc)"""


@query(
    "extract_mixed",
    with_tables(
        _MIXED,
        """SELECT CASE kind WHEN 0 THEN 'claim' WHEN 1 THEN 'account' WHEN 2 THEN 'admission' WHEN 3 THEN 'inpatient'
  WHEN 4 THEN 'dialysis' ELSE 'pharmacy' END AS layout, count(DISTINCT doc) AS documents, count(*) AS records,
  CAST(sum(total) AS DOUBLE) AS total_charges FROM units GROUP BY kind""",
    ),
)
def extract_mixed(spark, folder):
    """All layouts in one pass, counted per layout."""
    documents = ops.extract_documents(_pages(spark, folder))
    charges = F.aggregate(
        "records", F.lit(0).cast("decimal(28,2)"),
        lambda acc, r: (acc + r["total_charges"]).cast("decimal(28,2)"),
    )
    return (
        documents.select("layout", F.size("records").alias("n"), charges.alias("charges"))
        .groupBy("layout")
        .agg(
            F.count(F.lit(1)).alias("documents"), F.sum("n").alias("records"),
            F.sum("charges").cast("double").alias("total_charges"),
        )
    )


@query(
    "unextracted_documents",
    with_tables(
        _MIXED,
        """SELECT CAST(doc AS VARCHAR) AS doc_id, NULL AS layout, 'unknown_layout' AS reason FROM mixed
WHERE kind = 6 GROUP BY doc""",
    ),
)
def unextracted_documents(spark, folder):
    return ops.unextracted_documents(_pages(spark, folder))


@query(
    "document_layouts",
    with_tables(
        ORDER_TOTALS,
        """SELECT CAST(doc AS VARCHAR) AS doc_id, CASE doc % 7 WHEN 0 THEN 'claim' WHEN 1 THEN 'account'
  WHEN 2 THEN 'admission' WHEN 3 THEN 'inpatient' WHEN 4 THEN 'dialysis' WHEN 5 THEN 'pharmacy' END AS layout,
  CASE doc % 7 WHEN 0 THEN 'Alder Grove Clinic, PC' WHEN 1 THEN 'Pinecrest Scan Partners, Inc.' WHEN 2 THEN 'Harrow Lane Care'
    WHEN 3 THEN 'Mercy Hospital' WHEN 4 THEN 'Kidney Partners' WHEN 5 THEN 'Juniper Street Pharmacy' END AS provider
FROM ledger GROUP BY doc""",
    ),
)
def document_layouts(spark, folder):
    return document_facts(_pages(spark, folder)).select("doc_id", "layout", "provider")


@query(
    "claim_segments",
    with_tables(
        ORDER_TOTALS,
        """SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(idx AS INTEGER) AS seg,
  CASE WHEN k % 2 = 0 THEN '** CLAIM ' || (k + 100000) || ' **' ELSE 'Claim ID ' || (k + 100000) END AS heading
FROM ledger""",
    ),
)
def claim_segments(spark, folder):
    """Claim documents cut at their markers."""
    segments = segments_of(_pages(spark, folder, "claim"))
    return segments.select("doc_id", F.col("seg").cast("int").alias("seg"), F.substring_index("segment", "\n", 1).alias("heading"))


# ---------------------------------------------------------------- rules that combine sources

@query(
    "summary_over_items",
    with_tables(
        ORDER_TOTALS,
        """SELECT k, CASE WHEN k % 2 = 0 THEN 'summary' ELSE 'items' END AS basis, CAST(total AS DOUBLE) AS total_charges,
  CASE WHEN k % 2 = 0 THEN CAST(paid AS DOUBLE) END AS ins_paid FROM ledger""",
    ),
)
def summary_over_items(spark, folder):
    """Order totals from a summary where there is one (every second order), else from the items."""
    orders = warehouse.order_totals(spark, folder)
    null = lambda *names: [F.lit(None).cast("decimal(18,2)").alias(n) for n in names]
    items = warehouse.order_lines(spark, folder).select(
        "k", F.col("gross").cast("decimal(18,2)").alias("total_charges"),
        *null("ins_paid", "adjustment", "payments", "balance"),
    )
    stated = orders.where(F.col("k") % 2 == 0).select(
        "k", F.col("total").alias("total_charges"), F.col("paid").alias("ins_paid"), F.col("adj").alias("adjustment"),
        *null("payments"), F.col("open").alias("balance"),
    )
    return prefer_summary(items, stated, "k").select("k", "basis", *as_double("total_charges", "ins_paid"))


@query(
    "ledger_over_form",
    with_tables(
        ORDER_TOTALS,
        """SELECT k, CASE WHEN k % 4 = 0 THEN 'form' WHEN k % 4 = 1 THEN 'ledger' ELSE 'both' END AS source,
  CASE WHEN k % 4 = 0 THEN CAST(total + 1 AS DOUBLE) ELSE CAST(total AS DOUBLE) END AS total_charges,
  CASE WHEN k % 4 = 0 OR (k % 4 <> 1 AND k % 3 = 0) THEN 'form'
    WHEN k % 3 = 0 THEN NULL ELSE 'ledger' END AS description FROM ledger""",
    ),
)
def ledger_over_form(spark, folder):
    """Ledger rows win; claim forms fill a missing description and stand alone where there is no ledger."""
    orders = warehouse.order_totals(spark, folder).select("k", "total")
    k = F.col("k")
    ledger = orders.where(k % 4 != 0).select(
        "k", F.col("total").alias("total_charges"), F.when(k % 3 != 0, "ledger").alias("description")
    )
    forms = orders.where(k % 4 != 1).select(
        "k", (F.col("total") + 1).cast("decimal(18,2)").alias("total_charges"), F.lit("form").alias("description")
    )
    return prefer_ledger(ledger, forms, ["k"]).select("k", "source", *as_double("total_charges"), "description")
