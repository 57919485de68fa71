"""Third-party payers of printed pharmacy documents: long lists, party columns, payer details, fragments of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.operators.parties import third_parties, without_fragments
from tallyspark.plans.oracle_tables import SLOTS, with_tables
from tallyspark.plans.registry import query
from tallyspark.session import new_folder, stored
from tallyspark.sources import files, warehouse

NAMES = ["Corner Discount", "Delta PBM", "Sun Saver Card", "CAREX"]
LAST_PAGE = 2**31 - 1
_ORDER_PAGE = 2


def _pages(spark, lines: DataFrame, top: str, bottom: str | None = None) -> DataFrame:
    """``lines(doc_id, k, slot, text)`` as page files read back: a page per order, a heading, maybe a last page.

    Lines that are dealt by ``doc`` stay where they are.
    """
    dealt = ["doc"] if "doc" in lines.columns else []
    pages = lines.groupBy(*dealt, "doc_id", "k").agg(F.sort_array(F.collect_list(F.struct("slot", "text")))["text"].alias("texts"))
    orders = pages.select(
        "doc_id", (F.col("k") + _ORDER_PAGE).cast("int").alias("page_num"), F.array_join("texts", "\n").alias("page_content")
    )
    documents = lines.select("doc_id").distinct()
    page = lambda number, text: documents.select("doc_id", F.lit(number).alias("page_num"), F.lit(text).alias("page_content"))
    every = orders.unionByName(page(1, top))
    if bottom:
        every = every.unionByName(page(LAST_PAGE, bottom))
    path = new_folder(spark, "pages")
    every.write.parquet(path)
    return files.read_pages(spark, path)


def _listed(found: DataFrame) -> DataFrame:
    in_document = Window.partitionBy("doc_id").orderBy("first")
    place = F.row_number().over(in_document).alias("place")
    return found.select("doc_id", place, F.col("name").alias("third_party"), F.col("n").alias("mentions"))


def _fill_values(spark, folder, by_document: bool = False) -> DataFrame:
    part = F.col("part")
    name = F.get(F.array(*[F.lit(n) for n in NAMES]), (part % 4).cast("int"))
    dealt = warehouse.ledger_document() if by_document else None
    lines = warehouse.order_lines(spark, folder, dealt).withColumns(
        {
            "name": name, "day": F.date_format("first_ship", "MM/dd/yyyy"),
            "number": (F.col("k") % 9000000 + 1000000).cast("string"),
            "cost": F.concat(F.lit("$"), F.format_number("gross", 2)),
        }
    )
    return lines


_BASE = "CASE part % 4 WHEN 0 THEN 'Corner Discount' WHEN 1 THEN 'Delta PBM' WHEN 2 THEN 'Sun Saver Card' ELSE 'CAREX' END"

_LONG = SLOTS + f""", fills AS (
  SELECT CASE WHEN part % 50 = 0 THEN 'Rare Card' WHEN part % 25 = 1 THEN 'Harbor Plan' ELSE {_BASE} END AS name,
    row_number() OVER (ORDER BY k, slot) AS pos FROM slots), named AS (
  SELECT name, count(*) AS n, min(pos) AS pos FROM fills GROUP BY name)"""


@query(
    "extract_pharmacy_long",
    with_tables(
        _LONG,
        """SELECT 'all' AS doc_id, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS place, name AS third_party, n AS mentions
FROM named WHERE n >= (SELECT CASE WHEN count(*) >= 50 THEN greatest(3, floor(count(*) * 0.03)) ELSE 1 END FROM fills)""",
    ),
)
def extract_pharmacy_long(spark, folder):
    """All fills as one document; names go over up to three lines before their marker, and rare ones are left out."""
    fills = _fill_values(spark, folder)
    part, words = F.col("part"), F.split("name", " ")
    name = F.when(part % 50 == 0, "Rare Card").when(part % 25 == 1, "Harbor Plan").otherwise(F.col("name"))
    row = F.concat_ws(" ", "day", "number", F.lit("Ramipril 5mg 40118-0932-75 STRAND OLE 56 28"), "cost")
    ahead = F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ")
    end = F.concat(F.element_at(words, -1), F.lit(" (BIN 550071)"))
    text = F.when(part % 5 == 0, F.concat_ws("\n", row, ahead, end)).otherwise(
        F.concat(row, F.lit(" "), "name", F.lit(" (BIN 550071)"))
    )
    lines = fills.withColumn("name", name).select(F.lit("all").alias("doc_id"), "k", "slot", text.alias("text"))
    top = "Juniper Street Pharmacy Pharmacy Expense Report\nEarly Bird (BIN 1)\nDate Rx # Drug NDC Prescriber Qty Days Charge 3rd Party"
    bottom = "Payment Summary\nLate Comer (BIN 2)"
    return _listed(third_parties(_pages(spark, lines, top, bottom)))


_COLUMNS = SLOTS + f""", fills AS (
  SELECT k // 8 AS doc, {_BASE} AS name, row_number() OVER (PARTITION BY k // 8 ORDER BY k, slot) AS pos FROM slots),
named AS (SELECT doc, name, count(*) AS n, min(pos) AS pos FROM fills GROUP BY doc, name),
sized AS (SELECT doc, count(*) AS fills FROM fills GROUP BY doc)"""


@query(
    "extract_party_columns",
    with_tables(
        _COLUMNS,
        """SELECT CAST(n.doc AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY n.doc ORDER BY pos) AS INTEGER) AS place,
  name AS third_party, n AS mentions FROM named n JOIN sized s ON n.doc = s.doc
WHERE n >= CASE WHEN fills >= 50 THEN greatest(3, floor(fills * 0.03)) ELSE 1 END""",
    ),
)
def extract_party_columns(spark, folder):
    """Documents with a party column; every third name stands on the lines above and below its row instead."""
    fills = _fill_values(spark, folder, by_document=True)
    words = F.split("name", " ")
    row = lambda *cell: F.concat_ws(
        " ", "number", "day", F.lit("Zinc 40118-0932-77"), *cell, F.lit("LUNDE KIM 30 15"), "cost", F.lit("$1.00")
    )
    rest = F.array_join(F.slice(words, 2, 4), " ")
    beside = (F.col("part") % 3 == 0) & (F.size(words) > 1)
    text = F.when(beside, F.concat_ws("\n", F.element_at(words, 1), row(), rest)).otherwise(row("name"))
    lines = fills.select("doc", (F.floor(F.col("k") / 8)).cast("string").alias("doc_id"), (F.col("k") % 8).alias("k"), "slot", text.alias("text"))
    top = "Juniper Street Pharmacy Pharmacy Expense Report\nRx # Date Drug NDC 3rd Party\nPrescriber Qty Days Charge Copay"
    return _listed(third_parties(_pages(spark, lines, top)))


_DETAILS = SLOTS + f""", entries AS (
  SELECT k // 8 AS doc, CASE WHEN part % 4 = 1 AND slot % 2 = 0 THEN 'delta pbm' ELSE {_BASE} END AS name,
    row_number() OVER (PARTITION BY k // 8 ORDER BY k, slot) AS pos FROM slots WHERE qty <= 45 AND part % 5 <> 4)"""


@query(
    "extract_party_details",
    with_tables(
        _DETAILS,
        """SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY min(pos)) AS INTEGER) AS place,
  arg_min(name, pos) AS third_party, count(*) AS mentions FROM entries GROUP BY doc, lower(name)""",
    ),
)
def extract_party_details(spark, folder):
    """Documents with a payer detail section: rows without money, and capitals too long for a name, are left out."""
    values = _fill_values(spark, folder, by_document=True)
    part = F.col("part")
    name = F.when(part % 5 == 4, "LONGCARD").when((part % 4 == 1) & (F.col("slot") % 2 == 0), "delta pbm").otherwise(F.col("name"))
    paid = F.when(F.col("qty") <= 45, F.col("cost")).otherwise("open")
    text = F.concat_ws(" ", name, F.lit(" BIN 0042 "), paid)
    lines = values.select("doc", (F.floor(F.col("k") / 8)).cast("string").alias("doc_id"), (F.col("k") % 8).alias("k"), "slot", text.alias("text"))
    top = "Juniper Street Pharmacy Pharmacy Expense Report\nThird-Party Payer Detail\nPayer Name BIN Paid"
    return _listed(third_parties(_pages(spark, lines, top, "Grand Total $9.00\nLate Comer $1.00")))


_NAMES = SLOTS + """, places AS (
  SELECT 'all' AS doc_id, slot, part AS p FROM slots UNION ALL
  SELECT CAST(k // 8 AS VARCHAR), slot, part % 20 FROM slots), names AS (
  SELECT DISTINCT doc_id, CASE slot % 4 WHEN 0 THEN 'W' || p WHEN 1 THEN 'Plan w' || p || ' Fund' WHEN 2 THEN 'Group' || p || ' Health'
    ELSE 'group' || p || ' health Trust' END AS name FROM places), words AS (
  SELECT DISTINCT doc_id, lower(name) AS other, unnest(string_split(lower(name), ' ')) AS word FROM names)"""


@query(
    "party_fragments",
    with_tables(
        _NAMES,
        """SELECT doc_id, name FROM names n
WHERE NOT (strpos(name, ' ') = 0 AND EXISTS (SELECT 1 FROM words w WHERE w.doc_id = n.doc_id AND w.word = lower(n.name) AND w.other <> w.word))
  AND NOT (name LIKE 'Group% Health' AND EXISTS (SELECT 1 FROM names o WHERE o.doc_id = n.doc_id AND o.name = lower(n.name) || ' Trust'))""",
    ),
)
def party_fragments(spark, folder):
    """Names of every document of eight orders, and of all orders as one, without those that are part of another name."""
    lines = warehouse.order_lines(spark, folder, warehouse.ledger_document())
    part, kind = F.col("part").cast("long"), (F.col("slot") % 4).cast("int")
    place = lambda whole, doc, p: F.struct(
        F.lit(whole).alias("whole"), doc.alias("doc"), p.alias("p"), F.when(p.isNotNull(), kind).alias("kind")
    )
    places = F.array(place(True, F.lit(None).cast("long"), part), place(False, F.floor(F.col("k") / 8), part % 20))
    # the names as numbers first, of which each document has few
    different = lines.select(F.inline(places)).distinct()
    p = F.col("p").cast("string")
    kinds = [
        F.concat(F.lit("W"), p), F.concat(F.lit("Plan w"), p, F.lit(" Fund")), F.concat(F.lit("Group"), p, F.lit(" Health")),
        F.concat(F.lit("group"), p, F.lit(" health Trust")),
    ]
    doc_id = F.when(F.col("whole"), "all").otherwise(F.col("doc").cast("string"))
    names = different.select(doc_id.alias("doc_id"), F.get(F.array(*kinds), F.col("kind")).alias("name"))
    return without_fragments(stored(names, "names"))
