"""The derived tables of ``sources.warehouse`` once more, as SQL for the oracles."""

SLOTS = """slots AS (
  SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST,
      l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST,
      l_discount NULLS FIRST, l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST,
      l_shipdate NULLS FIRST) AS slot,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS disc,
    CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS tax,
    l_tax AS max_tax, l_shipdate AS first_ship, l_shipdate + to_days(CAST(l_partkey % 5 AS INTEGER)) AS last_ship,
    l_returnflag AS flag, l_linestatus AS line_status, l_suppkey AS supp, l_partkey AS part,
    l_quantity AS qty, l_partkey % 2 + 1 AS n
  FROM lineitem)"""

RECORDS = SLOTS + """, parts_of AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS idx,
    CASE WHEN qty <= 48 THEN CAST(gross * CAST(0.50 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS ins_paid,
    CASE WHEN max_tax <> 0 THEN CAST(tax AS DECIMAL(18,2)) END AS payments,
    CAST(disc AS DECIMAL(18,2)) AS adjustment
  FROM slots), recs AS (
  SELECT k, idx, slot, qty, 'job-' || k AS job_id,
    CASE WHEN slot = 6 OR flag = 'N' THEN NULL ELSE 'INV-' || k || '-' || (slot % 2) END AS invoice_number,
    CASE WHEN slot = 3 AND flag = 'R' THEN 'Various'
         WHEN slot = 1 THEN strftime(first_ship, '%Y-%m-%d')
         WHEN slot = 2 THEN strftime(first_ship, '%-m-%-d-%y')
         WHEN line_status = 'F' THEN strftime(first_ship, '%m/%d/%Y')
         ELSE strftime(first_ship, '%m/%d/%Y') || ' – ' || strftime(last_ship, '%m/%d/%Y') END AS treatment_date,
    CASE WHEN slot = 3 AND flag = 'R' THEN NULL ELSE CAST(first_ship AS DATE) END AS start_date,
    CASE WHEN slot = 3 AND flag = 'R' THEN NULL
         WHEN slot IN (1, 2) OR line_status = 'F' THEN CAST(first_ship AS DATE)
         ELSE CAST(last_ship AS DATE) END AS end_date,
    '9' || lpad(CAST(part % 10000 AS VARCHAR), 4, '0') AS code, n,
    CASE WHEN part % 11 <> 0 THEN 'Service ' || (part % 97) END AS description,
    'Supplier#' || lpad(CAST(supp AS VARCHAR), 9, '0') AS provider,
    CASE WHEN supp % 7 <> 0 THEN 'Payer ' || (part % 25) END AS insurer,
    CASE WHEN part % 3 = 0 THEN 'Partner ' || (supp % 10) END AS partner,
    CASE WHEN part % 3 = 0 THEN 'Payer ' || (part % 25) END AS partner2,
    gross AS total_charges, ins_paid, adjustment, payments,
    CAST(CASE WHEN slot = 7 THEN 0
      ELSE gross - adjustment - coalesce(ins_paid, 0) - coalesce(payments, 0) END AS DECIMAL(18,2)) AS balance,
    CAST(slot + 1 AS VARCHAR) AS page
  FROM parts_of)"""

JOBS = """jobs AS (
  SELECT o_orderkey AS k, 'job-' || o_orderkey AS id, 'user-' || o_custkey AS owner_id, o_custkey,
    'source-' || o_orderkey || '.pdf' AS pdf_filename,
    CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE '/app/pdfs/user-' || o_custkey || '/' END
      || 'source-' || o_orderkey || '.pdf' AS pdf_path,
    CASE WHEN o_orderstatus = 'F' THEN 'completed'
         WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'cancelled'
         WHEN o_orderstatus = 'O' THEN 'pending'
         WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'processing' END AS status,
    CASE WHEN o_orderkey % 97 <> 0 THEN sha256(o_orderpriority || year(o_orderdate)) END AS content_hash,
    o_orderkey % 4 AS attempts,
    o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) AS created_at,
    o_orderpriority AS priority, year(o_orderdate) AS order_year
  FROM orders), job_times AS (
  SELECT *,
    CASE WHEN status IN ('completed','processing','failed') THEN created_at + INTERVAL 5 MINUTE END AS started_at,
    CASE WHEN status IN ('completed','failed','cancelled')
      THEN created_at + to_minutes(CAST(k % 50 + 10 AS BIGINT)) END AS completed_at,
    CASE WHEN status = 'failed' THEN 'ParseError: no table' END AS error,
    CASE WHEN status = 'completed' THEN CASE WHEN k % 5 = 0 THEN CAST(0 AS DOUBLE) ELSE (k % 900) / CAST(10 AS DOUBLE) END END AS duration
  FROM jobs)"""

REPORT = RECORDS + ", " + JOBS + """, report AS (
  SELECT r.*, j.owner_id, 'source-' || r.k || '.pdf' AS source_file,
    (r.qty > 45) OR j.priority = '1-URGENT' AS needs_review,
    concat_ws('|', CASE WHEN j.priority = '1-URGENT' THEN 'Urgent document' END,
      CASE WHEN r.qty > 45 THEN 'High quantity ' || CAST(r.qty AS INTEGER) END) AS review_reasons,
    list_filter([insurer, partner, CASE WHEN partner2 IS DISTINCT FROM insurer THEN partner2 END],
      lambda x: x IS NOT NULL) AS payers
  FROM recs r JOIN jobs j ON r.k = j.k WHERE j.status = 'completed')"""

ORDER_TOTALS = SLOTS + """, sums AS (
  SELECT k, CAST(sum(gross) AS DECIMAL(18,2)) AS total, CAST(sum(disc) AS DECIMAL(18,4)) AS disc,
    min(first_ship) AS first_ship, max(last_ship) AS last_ship, CAST(sum(n) AS BIGINT) AS n, min(part) AS part,
    string_agg('9' || lpad(CAST(part % 10000 AS VARCHAR), 4, '0'), '|' ORDER BY slot) AS claim_codes,
    string_agg('7' || lpad(CAST(part % 10000 AS VARCHAR), 4, '0'), '|' ORDER BY slot) AS account_codes,
    arg_min(first_ship, slot) AS first_slot_ship, max(first_ship) AS last_first_ship
  FROM slots GROUP BY k), totals AS (
  SELECT *, k // 8 AS doc, CAST(total * CAST(0.50 AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS paid,
    CAST(disc AS DECIMAL(18,2)) AS adj, CAST((k % 8) // 3 + 2 AS INTEGER) AS page, (k % 8) IN (2, 5) AS split,
    strftime(first_ship, '%m/%d/%Y') AS d1, strftime(last_ship, '%m/%d/%Y') AS d2,
    strftime(first_slot_ship, '%m/%d/%Y') AS dc, strftime(last_first_ship, '%m/%d/%Y') AS d3,
    row_number() OVER (PARTITION BY k // 8 ORDER BY k) - 1 AS idx
  FROM sums), ledger AS (
  SELECT *, total - paid - adj AS open,
    CASE WHEN split THEN page || '-' || (page + 1) ELSE CAST(page AS VARCHAR) END AS pages
  FROM totals)"""


def with_tables(tables: str, select: str) -> str:
    return f"WITH {tables}\n{select}"
