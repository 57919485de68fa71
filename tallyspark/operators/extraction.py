"""Pages to billing records: one pass over all six document layouts.

Plan shape: ``segments`` cuts documents into segments, one row each, without holding a document; every segment is read
with one regular expression per field. What concerns a document as a whole (numbering, payer vote, an impossible date)
comes from sums over blocks of its records, which are stored and hold no texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark import fixed
from tallyspark.functions.dates import printed_range
from tallyspark.functions.money import amount_after, amounts_in, labelled_amount
from tallyspark.functions.parties import billing_section, third_parties
from tallyspark.functions.payers import claim_payer, payer_in
from tallyspark.functions.text import all_matches, first_match, first_text, has, let, lines_of, name_words, rx, strip
from tallyspark.operators.segments import (
    ACCOUNT, ADMISSION, CLAIM, DIALYSIS, INPATIENT, MARKERS, NO_DOCUMENT, PHARMACY, by_layout, document_blocks,
    document_facts, marker_line, segments_of,
)
from tallyspark.schema import FLAG, MONEY_TYPE, RECORD, RECORD_FIELDS
from tallyspark.session import stored


def _marker_group(number: int, layouts: list[str]) -> Column:
    """A group of the marker that opens the segment, for the layouts whose marker has it."""
    choices = {}
    for name in layouts:
        choices[name] = first_text(F.col("segment"), rf"\A{marker_line(name)}", number, "im")
    return by_layout(choices)


def _four_amounts() -> Column:
    """Charges, insurer, adjustment and balance; null entries or a short list mean the row is skipped."""
    segment = F.col("segment")
    total = lambda pattern: amounts_in(first_text(segment, pattern, 0, "im"))
    labels = lambda names: F.array(*[labelled_amount(segment, n) for n in names])
    return by_layout(
        {
            CLAIM: total(fixed.CLAIM_TOTAL_LINE),
            ACCOUNT: total(fixed.ACCOUNT_TOTAL_LINE),
            ADMISSION: labels(fixed.ADMISSION_LABELS),
            INPATIENT: labels(fixed.INPATIENT_LABELS),
            DIALYSIS: F.array(*[amount_after(segment, p, "im") for p in fixed.DIALYSIS_AMOUNTS]),
        }
    )


def _pharmacy_amounts(text: Column) -> Column:
    """Charges, insurer, adjustment, payments from a totals line or the payment summary."""
    totals = F.concat(*[first_text(text, p, 0, "im") for p in fixed.PHARMACY_TOTALS])
    summary = first_text(text, fixed.PHARMACY_SUMMARY, 0, "i")
    null = F.lit(None).cast(MONEY_TYPE)
    pick = lambda a, *places: F.array(*[F.get(a, F.lit(p)) if p is not None else null for p in places])
    both = F.struct(amounts_in(totals).alias("totals"), amounts_in(summary).alias("summary"))
    return let(
        both,
        lambda x: F.when(F.size(x["totals"]) > 0, pick(x["totals"], 0, 1, None, 2)).when(
            F.size(x["summary"]) > 0, pick(x["summary"], 3, 1, 2, 0)
        ),
    )


def _continued_diagnosis() -> Column:
    first = strip(F.col("_group3"))
    following = F.transform(F.slice(lines_of(F.col("segment")), 2, 3), strip)
    return let(
        F.get(F.filter(following, lambda line: line != ""), F.lit(0)),
        lambda line: F.when(
            line.isNotNull() & ~has(line, fixed.DIAGNOSIS_STOP, "i"), F.concat(first, F.lit(" "), line)
        ).otherwise(first),
    )


def _segment_records(segments: DataFrame) -> DataFrame:
    """Every segment read as a record, with ``valid`` telling whether it is one.

    A filter on ``valid`` here would be pushed below the projections and repeat all their expressions, so the
    caller leaves invalid segments out while it gathers the rest.
    """
    segment, layout = F.col("segment"), F.col("layout")

    groups = (
        segments.withColumn("_group1", _marker_group(1, list(MARKERS)))
        .withColumn("_group2", _marker_group(2, [CLAIM, ADMISSION, INPATIENT, DIALYSIS]))
        .withColumn("_group3", _marker_group(3, [ADMISSION, DIALYSIS]))
        .withColumn("_group4", _marker_group(4, [DIALYSIS]))
    )
    claim_id = F.concat("_group1", "_group2")
    # charge lines of any claim by one constant pattern; those of this one carry its number
    line = rf"^\s*(\d+\s+{fixed.CODE}\s+{fixed.DATE})\s+.*?\bCHARGE\b"
    mine = F.filter(all_matches(segment, line, 1, "m"), lambda x: first_text(x, r"^\d+", 0) == claim_id)
    claim_rows = lambda group: F.transform(
        F.col("_charges"), lambda x: first_text(x, rf"^\d+\s+({fixed.CODE})\s+({fixed.DATE})", group)
    )
    account_rows = lambda group: all_matches(segment, fixed.ACCOUNT_ROW, group, "m")
    none = F.array().cast("array<string>")

    read = (
        groups.withColumn("_charges", F.when(layout == CLAIM, mine))
        .withColumn("_section", F.when(layout == PHARMACY, billing_section(segment)))
        .withColumn("_amounts", F.when(layout == PHARMACY, _pharmacy_amounts(segment)).otherwise(_four_amounts()))
        .withColumn("_codes", by_layout({CLAIM: claim_rows(1), ACCOUNT: account_rows(2)}, none))
        .withColumn(
            "_dates",
            by_layout(
                {
                    CLAIM: F.slice(claim_rows(2), 1, 1),
                    ACCOUNT: account_rows(1),
                    PHARMACY: all_matches(F.col("_section"), fixed.DATE, 0),
                }
            ),
        )
    )

    amount = lambda i: F.get("_amounts", F.lit(i))
    complete = (F.size("_amounts") == 4) & ~F.exists("_amounts", lambda a: a.isNull())
    valid = by_layout(
        {
            CLAIM: complete & (F.size("_codes") > 0),
            ACCOUNT: complete & (F.size("_codes") > 0),
            ADMISSION: complete,
            INPATIENT: complete & has(segment, fixed.INPATIENT_DIAGNOSIS, "im"),
            DIALYSIS: complete,
            PHARMACY: F.col("_amounts").isNotNull() & (F.size("_dates") > 0),
        }
    )
    marker_range = F.concat("_group1", F.lit(" - "), "_group2")
    dates = by_layout(
        {
            CLAIM: F.get("_dates", F.lit(0)),
            ACCOUNT: printed_range(F.col("_dates")),
            PHARMACY: printed_range(F.col("_dates")),
        },
        marker_range,
    )
    description = by_layout(
        {
            ADMISSION: _continued_diagnosis(),
            INPATIENT: strip(first_text(segment, fixed.INPATIENT_DIAGNOSIS, 1, "im")),
            DIALYSIS: F.concat(
                F.lit("Dialysis — "), F.col("_group3").try_cast("decimal(38,0)").cast("string"), F.lit(" treatments")
            ),
            PHARMACY: F.when(segment.contains(fixed.PHARMACY_REPORT), fixed.PHARMACY_REPORT).otherwise(
                fixed.PHARMACY_RECORD
            ),
        }
    )
    own_payer = by_layout(
        {
            CLAIM: claim_payer(lines_of(segment), claim_id),
            DIALYSIS: strip(first_match(segment, fixed.DIALYSIS_INSURER, 1, "i")),
        }
    )
    payer = F.coalesce(
        own_payer, F.when(layout.isin(CLAIM, DIALYSIS), payer_in(segment)).otherwise(F.col("document_payer"))
    )
    fields = {
        "invoice_number": by_layout(
            {
                CLAIM: F.concat(F.lit("Claim "), claim_id),
                ACCOUNT: F.concat(F.lit("Account "), "_group1"),
                DIALYSIS: F.col("_group4"),
            }
        ),
        "treatment_date": dates,
        "cpt_codes": F.col("_codes"),
        "description": description,
        "provider": F.col("provider"),
        "insurers": F.when(layout == PHARMACY, none).otherwise(F.array_compact(F.array(payer))),
        "third_parties": F.when(layout == PHARMACY, third_parties(segment, F.col("_section"))).otherwise(none),
        "total_charges": amount(0),
        "ins_paid": amount(1),
        "adjustment": amount(2),
        "payments": F.when(layout == PHARMACY, amount(3)),
        "balance": F.when(layout == PHARMACY, F.lit(0).cast(MONEY_TYPE)).otherwise(amount(3)),
        "page": F.col("page"),
    }
    return read.select(
        "doc_id", "layout", "seg", valid.alias("valid"), *[fields[name].alias(name) for name in RECORD_FIELDS]
    )


RECORD_BLOCK = 4096  # segments whose records are numbered together


def _valid_records(segments: DataFrame) -> DataFrame:
    """The valid records, stored: they hold no texts, and several aggregates read them. ``_doc`` is never null."""
    read = _segment_records(segments).withColumns(
        {"_doc": F.coalesce("doc_id", F.lit(NO_DOCUMENT)), "_block": F.floor(F.col("seg") / RECORD_BLOCK)}
    )
    return stored(read, "records").where("valid").drop("valid")


def _named_payer() -> Column:
    """The payer that votes: the one a claim names."""
    payer = F.get("insurers", F.lit(0))
    return F.when((F.col("layout") == CLAIM) & (payer != fixed.UNNAMED_PAYER), payer)


def _voted(rows: DataFrame) -> DataFrame:
    """Claims with the variants of the payer that their document names most often rewritten to that name.

    The unnamed payer neither counts nor changes. Ties go to the name seen first. ``_top`` and ``_claims`` are the vote and
    the records of the document.
    """
    rows = rows.withColumn("_named", _named_payer())
    top, low = F.col("_top.name"), F.lower("_named")
    key = F.lower(top)
    alike = key.contains(low) | low.contains(key) | F.arrays_overlap(name_words(F.col("_named")), name_words(top))
    enough = F.col("_top.n") >= F.greatest(F.lit(2), F.floor(F.col("_claims") / 4))
    other = F.col("_named") != top
    settled = F.when(F.coalesce(enough & other & alike, F.lit(False)), F.array(top)).otherwise(F.col("insurers"))
    return rows.withColumn("insurers", settled).drop("_named")


def _block_facts(rows: DataFrame) -> DataFrame:
    """Per document and block of segments: the records before it, and size, vote and bad dates of the document."""
    blocks = rows.groupBy("_doc", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("treatment_date").isNull()).alias("bad")
    )
    document = Window.partitionBy("_doc")
    before = document.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    facts = blocks.select(
        "_doc", "_block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"),
        F.sum("n").over(document).alias("_claims"), F.max("bad").over(document).alias("_bad"),
    )
    names = rows.withColumn("name", _named_payer()).where("name IS NOT NULL").groupBy("_doc", "name").agg(
        F.count(F.lit(1)).alias("n"), (-F.min("seg")).alias("order")
    )
    top = names.groupBy("_doc").agg(F.max(F.struct("n", "order", "name")).alias("_top"))
    return facts.join(top, "_doc", "left")


_DONE = "done"


def extract_records(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row per billing record, numbered from zero within its document.

    Documents without a known layout, without a readable row, with an impossible date, or longer than the limit yield
    nothing here; they are what ``unextracted_documents`` lists.
    """
    records = _valid_records(segments_of(pages, max_pages))
    rows = _voted(records.join(_block_facts(records).where(~F.col("_bad")), ["_doc", "_block"]))
    place = F.row_number().over(Window.partitionBy("_doc", "_block").orderBy("seg"))
    idx = (F.col("_base") + place - 1).cast("int").alias("idx")
    return rows.select("doc_id", "layout", idx, F.struct(*RECORD_FIELDS).cast(RECORD).alias("_r")).select(
        "doc_id", "layout", "idx", "_r.*"
    )


def extract_documents(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """``doc_id, layout, records, flagged`` for every document that yields records."""
    numbered = F.struct("idx", F.struct(*RECORD_FIELDS).cast(RECORD).alias("record"))
    gathered = extract_records(pages, max_pages).groupBy("doc_id", "layout").agg(F.sort_array(F.collect_list(numbered)).alias("_rows"))
    return gathered.select(
        "doc_id", "layout", F.col("_rows.record").alias("records"), F.array().cast(f"array<{FLAG}>").alias("flagged")
    )


def unextracted_documents(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Documents that need another way of extraction, and why."""
    blocks = document_blocks(pages)
    documents = document_facts(pages, max_pages, blocks).select("doc_id", "layout", "too_long")
    records = _valid_records(segments_of(pages, max_pages, blocks))
    states = records.groupBy(F.nullif("_doc", F.lit(NO_DOCUMENT)).alias("s_doc")).agg(
        F.when(F.max(F.col("treatment_date").isNull()), "bad_date").otherwise(_DONE).alias("state")
    )
    reason = (
        F.when(F.col("too_long"), "too_long")
        .when(F.col("layout").isNull(), "unknown_layout")
        .otherwise(F.coalesce("state", F.lit("no_readable_rows")))
    )
    met = documents.join(states, F.col("doc_id").eqNullSafe(F.col("s_doc")), "left")
    return met.select("doc_id", "layout", reason.alias("reason")).where(F.col("reason") != _DONE)
