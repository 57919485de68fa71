"""Queries over page texts and document contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark import fixed
from tallyspark.functions.page_kinds import image_area_ratio
from tallyspark.functions.text import squeeze
from tallyspark.operators import pages as ops
from tallyspark.plans.oracle_tables import with_tables
from tallyspark.plans.registry import joined, query
from tallyspark.sources import files, warehouse

PAGES = r"""pages_of AS (
  SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn + 1 AS INTEGER) AS page_num, conv_id, turn, role,
    text AS page_content FROM conversations),
  texts AS (SELECT *, trim(regexp_replace(page_content, '\s+', ' ', 'g')) AS squeezed FROM pages_of)"""


def _pages(spark, folder):
    return warehouse.conversation_pages(spark, folder)


@query(
    "page_offsets",
    with_tables(
        PAGES,
        """SELECT doc_id, page_num, CAST(start AS BIGINT) AS "start", CAST(start + n AS BIGINT) AS "end" FROM (
  SELECT doc_id, page_num, length(page_content) AS n, coalesce(sum(length(page_content) + 1) OVER (
    PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM pages_of)""",
    ),
)
def page_offsets(spark, folder):
    return ops.page_offsets(_pages(spark, folder))


@query(
    "page_search",
    with_tables(
        PAGES,
        "SELECT doc_id, page_num, left(squeezed, 140) AS snippet FROM texts WHERE contains(lower(page_content), 'the')",
    ),
)
def page_search(spark, folder):
    return ops.search_pages(_pages(spark, folder), " THE ")


@query(
    "page_outline",
    with_tables(
        PAGES,
        """, kinds AS (SELECT doc_id, page_num, squeezed, lower(page_content) AS t FROM texts), named AS (
  SELECT *, CASE WHEN squeezed = '' THEN 'empty'
    WHEN t LIKE '%records pertaining to%' OR t LIKE '%records custodian%' THEN 'cover'
    WHEN t LIKE '%certification of records%' THEN 'certification'
    WHEN t LIKE '%laboratory report%' OR (t LIKE '%test name%' AND t LIKE '%reference range%') THEN 'lab_report'
    WHEN t LIKE '%rx #%' OR t LIKE '%fill date%' OR t LIKE '%3rd party%'
      OR (t LIKE '%ndc%' AND t LIKE '%copay%') THEN 'pharmacy_ledger'
    WHEN t LIKE '%billing summary%' OR t LIKE '%claim id%' OR t LIKE '%claim total%'
      OR t LIKE '%contractual adjustment%' THEN 'billing_ledger'
    WHEN t LIKE '%clinical note%' OR t LIKE '%prescriber:%' OR (t LIKE '%diagnosis:%' AND t LIKE '%npi:%')
      THEN 'prescription' ELSE 'other' END AS kind FROM kinds)
SELECT doc_id, page_num, kind, CASE WHEN kind IN ('billing_ledger','pharmacy_ledger') THEN 'billing'
  WHEN kind = 'other' THEN 'undecided' ELSE 'noise' END AS use, left(squeezed, 100) AS snippet FROM named""",
    ).replace("\n, kinds", ", kinds"),
)
def page_outline(spark, folder):
    return ops.outline_pages(_pages(spark, folder))


@query(
    "page_read",
    with_tables(
        PAGES,
        """, wanted AS (SELECT doc_id, unnest([last, 1, 99, 1]) AS page_num, unnest([0, 1, 2, 3]) AS pos
  FROM (SELECT doc_id, max(page_num) AS last FROM pages_of GROUP BY doc_id))
SELECT w.doc_id, w.pos, w.page_num,
  CASE WHEN p.doc_id IS NULL THEN 'missing' WHEN trim(p.squeezed) = '' THEN 'blank' ELSE 'text' END AS status,
  CASE WHEN p.doc_id IS NULL THEN '(out of range)' WHEN p.squeezed = '' THEN '(no extractable text on this page)'
    ELSE regexp_replace(p.page_content, '^\\s+|\\s+$', '', 'g') END AS body
FROM wanted w LEFT JOIN texts p ON w.doc_id = p.doc_id AND w.page_num = p.page_num""",
    ).replace("\n, wanted", ", wanted").replace("\\\\s", "\\s"),
)
def page_read(spark, folder):
    """Of every document the last page, the first, one that does not exist, and the first again."""
    pages = _pages(spark, folder)
    asked = pages.groupBy("doc_id").agg(
        F.array(F.max("page_num"), F.lit(1), F.lit(99), F.lit(1)).alias("page_nums")
    )
    return ops.read_pages(asked, pages)


@query(
    "document_routes",
    with_tables(
        PAGES,
        """, marked AS (SELECT doc_id, page_num, squeezed <> '' AS filled,
    turn % 3 = 0 AND (length(squeezed) < 20 OR (60.0 * (conv_id % 10)) * 400.0 / 480000.0 >= 0.2) AS visual FROM texts),
  docs AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE filled) AS n_filled,
    string_agg(CAST(page_num AS VARCHAR), '|' ORDER BY page_num) FILTER (WHERE visual) AS v,
    string_agg(CAST(page_num AS VARCHAR), '|' ORDER BY page_num) AS a FROM marked GROUP BY doc_id)
SELECT doc_id, n_pages, n_filled,
  CASE WHEN n_pages > 400 THEN 'reject_too_long' WHEN n_filled = 0 OR v IS NOT NULL THEN 'visual' ELSE 'text' END AS route,
  CASE WHEN n_pages > 400 THEN '' WHEN n_filled = 0 THEN a ELSE coalesce(v, '') END AS visual_pages FROM docs""",
    ).replace("\n, marked", ", marked"),
)
def document_routes(spark, folder):
    pages = _pages(spark, folder).select(
        "doc_id", "page_num", "page_content",
        F.size("images").alias("n_images"),
        image_area_ratio(F.col("images"), F.col("width"), F.col("height")).alias("image_area_ratio"),
    )
    routes = ops.route_documents(pages)
    return routes.select("doc_id", "n_pages", "n_filled", "route", joined("visual_pages"))


@query(
    "document_fingerprints",
    """SELECT sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_doc,
  CASE WHEN max(octet_length(encode(text))) > 26214400 THEN 'too_large' ELSE 'accepted' END AS state
FROM documents WHERE octet_length(encode(text)) >= 1 GROUP BY sha256(text)""",
)
def document_fingerprints(spark, folder):
    """Exact copies by the hash of their bytes: each content is to be processed once, too large ones are marked."""
    texts = warehouse.table(spark, folder, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    size = F.length("content")
    hashed = texts.where(size > 0).select("doc_id", F.sha2("content", 256).alias("content_hash"), size.alias("size"))
    return hashed.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("doc_id").alias("first_doc"),
        F.when(F.max("size") > fixed.MAX_FILE_BYTES, "too_large").otherwise("accepted").alias("state"),
    )


@query(
    "document_admission",
    """SELECT doc_id, CASE WHEN octet_length(b) > 4000 THEN 'too_large' WHEN octet_length(b) = 0 THEN 'empty'
  WHEN doc_id % 3 = 0 THEN 'not_pdf' ELSE 'accepted' END AS state,
  CASE WHEN octet_length(b) BETWEEN 1 AND 4000 AND doc_id % 3 <> 0 THEN sha256(b) END AS content_hash
FROM (SELECT doc_id, encode(CASE doc_id % 3 WHEN 0 THEN '' ELSE '%PDF-' END || text) AS b FROM documents)""",
)
def document_admission(spark, folder):
    """Admission of binary contents: two of three carry the file mark; the size limit here is 4,000 bytes."""
    mark = F.when(F.col("doc_id") % 3 == 0, "").otherwise(fixed.FILE_MAGIC)
    content = warehouse.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.concat(mark, "text").cast("binary").alias("content")
    )
    stored = content.select(
        "path", "content", F.length("content").cast("bigint").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
    )
    admitted = files.admit_documents(stored, max_bytes=4000)
    return admitted.select(F.col("path").cast("bigint").alias("doc_id"), "state", "content_hash")


@query(
    "squeezed_texts",
    r"SELECT doc_id, trim(regexp_replace(text, '[\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{3000}\x0b]+', ' ', 'g')) AS squeezed FROM documents",
)
def squeezed_texts(spark, folder):
    """Whole document texts with every run of blanks made one space."""
    return warehouse.table(spark, folder, "documents").select("doc_id", squeeze(F.col("text")).alias("squeezed"))
