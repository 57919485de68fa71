"""Billing tables derived from the order tables of a warehouse folder.

Every line item is a record of its own, numbered inside its order; a job holds as many records as its order has lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallyspark import fixed
from tallyspark.schema import FLAG, MONEY_COLUMNS, RECORD, RESULT

ORDERS_PER_DOCUMENT = 8
#: Order of the lines of an order; lines equal in all of them are interchangeable.
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus", "l_shipdate",
]
PAYER_NAMES = ["Quartz Meadow Health", "Quartz Meadow Plan", "Granite Mutual", "Harbor Life", fixed.UNNAMED_PAYER]
PARTY_NAMES = ["Corner Discount", "Delta PBM", "Sun Saver Card", "CAREX"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_lines(spark: SparkSession, folder: str, dealt: Column | None = None) -> DataFrame:
    """Line items as ``k``, ``slot`` (from one inside the order) and their values; one exchange, by order.

    ``dealt``, a value of ``k``, is given back as ``doc``; the exchange is then by it, so that grouping by ``doc``, or by
    ``doc`` and order, needs no other. Values are derived after the exchange, which carries the columns read and no more;
    its key is asked for by name, as the window alone would have them derived first. Amounts are taken as whole cents (and hundredths of cents), which is exact and stays
    in machine integers.
    """
    hundredths = lambda name: F.round(F.col(name) * 100).cast("bigint")
    scaled = lambda value, unit: value.cast("decimal(18,0)") * F.lit(unit).cast("decimal(4,4)")
    price, part = hundredths("l_extendedprice"), F.col("l_partkey")
    days = F.make_dt_interval((part % 5).cast("int"))
    items = table(spark, folder, "lineitem").withColumn("k", F.col("l_orderkey"))
    keys = ["k"]
    if dealt is not None:
        items, keys = items.withColumn("doc", dealt), ["doc", "k"]
    return items.repartition(keys[0]).select(
        *keys,
        F.row_number().over(Window.partitionBy(*keys).orderBy(*LINE_ORDER)).alias("slot"),
        scaled(price, "0.01").cast("decimal(18,2)").alias("gross"),
        scaled(price * hundredths("l_discount"), "0.0001").alias("disc"),
        scaled(price * hundredths("l_tax"), "0.0001").alias("tax"),
        F.col("l_tax").alias("max_tax"),
        F.col("l_shipdate").alias("first_ship"),
        (F.col("l_shipdate") + days).alias("last_ship"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_suppkey").alias("supp"),
        part.alias("part"),
        F.col("l_quantity").alias("qty"),
        (part % 2 + 1).alias("n"),
    )


def ledger_document() -> Column:
    """The printed document of an order."""
    return F.expr(f"k div {ORDERS_PER_DOCUMENT}")


def job_id() -> Column:
    return F.concat(F.lit("job-"), F.col("k").cast("string"))


def _cents(value: Column) -> Column:
    return value.cast("decimal(18,2)")


def _us(value: Column) -> Column:
    return F.date_format(value, "MM/dd/yyyy")


def slot_record() -> Column:
    """The billing record of one line."""
    c = F.col
    k = c("k").cast("string")
    invoice = F.concat(F.lit("INV-"), k, F.lit("-"), (c("slot") % 2).cast("string"))
    span = F.concat(_us(c("first_ship")), F.lit(" – "), _us(c("last_ship")))
    payer = F.concat(F.lit("Payer "), (c("part") % 25).cast("string"))
    partner = F.concat(F.lit("Partner "), (c("supp") % 10).cast("string"))
    code = F.concat(F.lit("9"), F.lpad((c("part") % 10000).cast("string"), 4, "0"))
    ins_paid = F.when(c("qty") <= 48, _cents(c("gross") * F.lit("0.50").cast("decimal(3,2)")))
    payments = F.when(c("max_tax") != 0, _cents(c("tax")))
    adjustment = _cents(c("disc"))
    open_amount = _cents(c("gross")) - adjustment
    for paid in (ins_paid, payments):
        open_amount = open_amount - F.coalesce(paid, F.lit(0).cast("decimal(18,2)"))
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(c("slot") == 6, "   ")
        .when(c("flag") == "N", None)
        .when(c("flag") == "R", F.concat(F.lit("  "), invoice, F.lit(" ")))
        .otherwise(invoice)
        .alias("invoice_number"),
        F.when((c("slot") == 3) & (c("flag") == "R"), "Various")
        .when(c("slot") == 1, F.date_format("first_ship", "yyyy-MM-dd"))
        .when(c("slot") == 2, F.date_format("first_ship", "M-d-yy"))
        .when(c("line_status") == "F", _us(c("first_ship")))
        .otherwise(span)
        .alias("treatment_date"),
        F.when(c("n") > 1, F.array(code, F.lit("36415,59"))).otherwise(F.array(code)).alias("cpt_codes"),
        F.when(c("part") % 11 != 0, F.concat(F.lit("Service "), (c("part") % 97).cast("string"))).alias("description"),
        F.concat(F.lit("Supplier#"), F.lpad(c("supp").cast("string"), 9, "0")).alias("provider"),
        F.when(c("supp") % 7 == 0, none).otherwise(F.array(payer)).alias("insurers"),
        F.when(c("part") % 3 == 0, F.array(partner, payer)).otherwise(none).alias("third_parties"),
        _cents(c("gross")).alias("total_charges"),
        ins_paid.alias("ins_paid"),
        adjustment.alias("adjustment"),
        payments.alias("payments"),
        F.when(c("slot") == 7, F.lit(0)).otherwise(open_amount).cast("decimal(18,2)").alias("balance"),
        (c("slot") + 1).cast("string").alias("page"),
    ).cast(RECORD)


def order_records(spark: SparkSession, folder: str, dealt: Column | None = None) -> DataFrame:
    """``k, records, flagged`` per order that has line items; flags mark lines of high quantity.

    With ``dealt`` as in ``order_lines``, rows lie by ``doc``, which comes first.
    """
    keys = ["k"] if dealt is None else ["doc", "k"]
    slots = order_lines(spark, folder, dealt).select(*keys, F.struct("slot", "qty", slot_record().alias("record")).alias("_s"))
    gathered = slots.groupBy(*keys).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    flags = F.array_compact(
        F.transform(
            "_s",
            lambda s, i: F.when(
                s["qty"] > 45,
                F.struct(
                    i.alias("row"),
                    F.array(F.lit("balance")).alias("fields"),
                    F.concat(F.lit("High quantity "), s["qty"].cast("int").cast("string")).alias("reason"),
                    (s["slot"] + 1).cast("string").alias("page"),
                    F.lit("medium").alias("severity"),
                ).cast(FLAG),
            ),
        )
    )
    return gathered.select(*keys, F.transform("_s", lambda s: s["record"]).alias("records"), flags.alias("flagged"))


def _minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Job table without results: one job per order."""
    c = F.col
    k = c("o_orderkey")
    owner = F.concat(F.lit("user-"), c("o_custkey").cast("string"))
    name = F.concat(F.lit("source-"), k.cast("string"), F.lit(".pdf"))
    created = c("o_orderdate").cast("timestamp") + _minutes(k % 1440)
    low = c("o_orderpriority") == "5-LOW"
    status = (
        F.when(c("o_orderstatus") == "F", fixed.COMPLETED)
        .when((c("o_orderstatus") == "O") & low, fixed.CANCELLED)
        .when(c("o_orderstatus") == "O", fixed.PENDING)
        .when(low, fixed.FAILED)
        .otherwise(fixed.PROCESSING)
    )
    base = table(spark, folder, "orders").select(
        k.alias("k"), status.alias("status"), owner.alias("owner_id"), name.alias("pdf_filename"),
        created.alias("created_at"), c("o_orderpriority").alias("priority"),
        F.year("o_orderdate").alias("order_year"),
    )
    content = F.concat("priority", F.col("order_year").cast("string"))
    started = c("status").isin(fixed.COMPLETED, fixed.PROCESSING, fixed.FAILED)
    ended = c("status").isin(fixed.COMPLETED, fixed.FAILED, fixed.CANCELLED)
    done = c("status") == fixed.COMPLETED
    tokens = F.create_map(F.lit("input"), c("k") % 5000 + 1000, F.lit("output"), c("k") % 700 + 50,
                          F.lit("total"), c("k") % 5000 + c("k") % 700 + 1050)
    return base.select(
        F.concat(F.lit("job-"), c("k").cast("string")).alias("id"),
        "owner_id",
        "pdf_filename",
        F.when(c("k") % 50 == 0, c("pdf_filename"))
        .otherwise(F.concat(F.lit("/app/pdfs/"), "owner_id", F.lit("/"), "pdf_filename"))
        .alias("pdf_path"),
        "status",
        F.when(c("k") % 97 != 0, F.sha2(content, 256)).alias("content_hash"),
        F.when(c("status") == fixed.FAILED, "ParseError: no table").alias("error"),
        F.when(done, tokens).alias("token_usage"),
        F.when(done, (c("k") % 5000) / F.lit(10000.0)).alias("cost_usd"),
        F.when(done & (c("k") % 5 == 0), 0.0).when(done, (c("k") % 900) / F.lit(10.0))
        .alias("processing_duration_seconds"),
        (c("k") % 4).cast("int").alias("attempts"),
        F.when(started, c("created_at") + _minutes(F.lit(5))).alias("started_at"),
        F.when(ended, c("created_at") + _minutes(c("k") % 50 + 10)).alias("completed_at"),
        "created_at",
        c("created_at").alias("updated_at"),
        "k",
        "priority",
        "order_year",
    )


def _with_document_flag(flagged: Column) -> Column:
    note = F.struct(
        F.lit(None).cast("int").alias("row"), F.array().cast("array<string>").alias("fields"),
        F.lit("Urgent document").alias("reason"), F.lit("1").alias("page"), F.lit("high").alias("severity"),
    ).cast(FLAG)
    return F.when(F.col("priority") == "1-URGENT", F.concat(flagged, F.array(note))).otherwise(flagged)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Job table with typed results for completed and failed jobs."""
    return with_results(spark, folder, job_rows(spark, folder))


def with_results(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """``rows`` of the job table with their results."""
    rows = rows.join(order_records(spark, folder), "k", "left")
    has_result = F.col("status").isin(fixed.COMPLETED, fixed.FAILED)
    none = F.array().cast(f"array<{FLAG}>")
    result = F.struct(
        F.coalesce("records", F.array().cast(f"array<{RECORD}>")).alias("records"),
        _with_document_flag(F.coalesce("flagged", none)).alias("flagged"),
    ).cast(RESULT)
    return rows.withColumn("result", F.when(has_result, result)).drop("records", "flagged")


def jobs_with_json(spark: SparkSession, folder: str) -> DataFrame:
    """Job table with results as stored JSON text, some of it malformed.

    Every third job has amounts as text, among them ``N/A`` and ``1e3``; a cancelled job has no record list.
    """
    rows = jobs(spark, folder)

    def text_amounts(record: Column) -> Column:
        text = record
        for name in MONEY_COLUMNS:
            shown = record[name].cast("string")
            if name == "total_charges":
                shown = F.when(record["page"] == "6", "N/A").otherwise(shown)
            if name == "balance":
                shown = F.when(record["page"] == "5", "1e3").otherwise(F.concat(F.lit(" "), shown, F.lit(" ")))
            text = text.withField(name, shown)
        return text

    as_text = F.to_json(
        F.struct(F.transform("result.records", text_amounts).alias("records"), F.col("result.flagged").alias("flagged"))
    )
    stored = (
        F.when(F.col("status") == fixed.CANCELLED, '{"records": "n/a", "flagged": []}')
        .when(F.col("result").isNull(), None)
        .when(F.col("k") % 3 == 0, as_text)
        .otherwise(F.to_json("result"))
    )
    return rows.withColumn("result", stored)


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """The records of every order as ground truth, in its own field names."""
    names = {pred: truth for truth, pred in fixed.SCORED_FIELDS}
    rename = lambda r: F.struct(
        *[(r[p].cast("double") if p in MONEY_COLUMNS else r[p]).alias(t) for p, t in names.items()]
    )
    return order_records(spark, folder, job_id()).select(
        "k", F.col("doc").alias("doc_id"), F.transform("records", rename).alias("records")
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Records with known errors: some documents missing, some without their first record, some fields changed."""
    k = F.col("k")

    def change(r: Column) -> Column:
        out = r.withField("provider", F.when(k % 5 == 0, F.concat(r["provider"], F.lit(" X"))).otherwise(
            F.concat(F.lit(" "), F.replace(r["provider"], F.lit("#"), F.lit("#")), F.lit("  "))))
        out = out.withField("third_parties", F.reverse(r["third_parties"]))
        for name in MONEY_COLUMNS:
            value = r[name].cast("double")
            out = out.withField(name, F.when(k % 3 == 0, value + 0.004).otherwise(value))
        return out.withField("page", F.when(k % 4 == 0, None).otherwise(r["page"]))

    changed = F.transform("records", change)
    kept = F.when(k % 7 == 0, F.slice(changed, F.lit(2), F.size(changed))).otherwise(changed)
    return (
        order_records(spark, folder, job_id())
        .where(k % 11 != 0)
        .select(F.col("doc").alias("doc_id"), kept.alias("records"))
    )


def conversation_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as pages, every text whole."""
    width = F.lit(60.0) * (F.col("conv_id") % 10)
    image = F.struct(
        F.lit(0.0).alias("x0"), width.alias("x1"), F.lit(100.0).alias("top"), F.lit(500.0).alias("bottom")
    )
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("doc_id"),
        (F.col("turn") + 1).cast("int").alias("page_num"),
        F.col("text").alias("page_content"),
        F.when(F.col("turn") % 3 == 0, F.array(image)).otherwise(F.array()).alias("images"),
        F.lit(600.0).alias("width"),
        F.lit(800.0).alias("height"),
    )


# ---------------------------------------------------------------- ledger documents

def order_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per order: totals, dates and its lines, with the document and page it is printed on."""
    slots = order_lines(spark, folder, ledger_document()).withColumn("amount", _cents(F.col("gross")))
    line = F.struct("slot", "part", "first_ship", "amount", "n")
    totals = slots.groupBy("doc", "k").agg(
        F.sort_array(F.collect_list(line)).alias("lines"),
        F.sum("gross").alias("gross"),
        F.sum("disc").alias("disc"),
        F.min("first_ship").alias("first_ship"),
        F.max("last_ship").alias("last_ship"),
        F.sum("n").alias("n"),
        F.min("part").alias("part"),
    )
    half = _cents(F.col("gross") * F.lit("0.50").cast("decimal(3,2)"))
    place = F.col("k") % ORDERS_PER_DOCUMENT
    return totals.select(
        "doc",
        "k",
        "lines",
        _cents(F.col("gross")).alias("total"),
        half.alias("paid"),
        _cents(F.col("disc")).alias("adj"),
        (_cents(F.col("gross")) - half - _cents(F.col("disc"))).alias("open"),
        "first_ship",
        "last_ship",
        "n",
        "part",
        (F.floor(place / 3) + 2).cast("int").alias("page"),
        place.isin(2, 5).alias("split"),
    )


def _money(value: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, 2))


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _amounts() -> Column:
    return F.concat_ws(" ", *[_money(F.col(c)) for c in ("total", "paid", "adj", "open")])


def _pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def _claim_block() -> tuple[Column, Column]:
    number = (F.col("k") + 100000).cast("string")
    unnamed = F.col("part") % len(PAYER_NAMES) == len(PAYER_NAMES) - 1
    shown = F.when(unnamed, "Insurance").otherwise(_pick(PAYER_NAMES, F.col("part") % len(PAYER_NAMES)))
    tail = F.when(unnamed, "\nPayment").otherwise("")
    opening = F.when(F.col("k") % 2 == 0, _text("** CLAIM ", number, " **")).otherwise(_text("Claim ID ", number))
    charge = lambda s: _text(
        "Item ", s["part"].cast("string"), " / ", shown, "\n", number, " 9", F.lpad((s["part"] % 10000).cast("string"), 4, "0"),
        " ", _us(s["first_ship"]), " CHARGE VESTER IDA ", _money(s["amount"]), tail, "\nPAYMENT CARD at the desk $-1.00",
    )
    body = _text(opening, "\n", F.array_join(F.transform("lines", charge), "\n"))
    return body, _text("CLAIM TOTAL: ", _amounts())


def _account_block() -> tuple[Column, Column]:
    row = lambda s: _text(
        _us(s["first_ship"]), " 7", F.lpad((s["part"] % 10000).cast("string"), 4, "0"), " X-ray ", _money(s["amount"])
    )
    body = _text("Account # ", F.col("k").cast("string"), "\n", F.array_join(F.transform("lines", row), "\n"))
    return body, _text("Account Subtotal: ", _amounts())


def _diagnosis() -> Column:
    return _text("Condition ", (F.col("part") % 50).cast("string"), " with acute")


def _admission_block() -> tuple[Column, Column]:
    wrapped = F.when(F.col("k") % 2 == 1, "\nexacerbation").otherwise("")
    body = _text(
        "Admission: ", _us(F.col("first_ship")), " | Discharge: ", _us(F.col("last_ship")), " | Diagnosis: ",
        _diagnosis(), wrapped, "\nCode\nBoard and care by night",
    )
    return body, _text(
        "Payment Summary\nTotal Charges: ", _money(F.col("total")), " Insurance Paid: ", _money(F.col("paid")),
        "\nContractual Adj: ", _money(F.col("adj")), " Patient Balance: ", _money(F.col("open")),
    )


def _inpatient_block() -> tuple[Column, Column]:
    body = _text(
        "Inpatient Episode: ", _us(F.col("first_ship")), " – ", _us(F.col("last_ship")), "\nDiagnosis: ", _diagnosis()
    )
    return body, _text(
        "Total Charges ", _money(F.col("total")), "\nInsurance Paid ", _money(F.col("paid")), "\nAdjustment ",
        _money(F.col("adj")), "\nPatient Balance ", _money(F.col("open")),
    )


def _dialysis_block() -> tuple[Column, Column]:
    insurer = F.when(
        F.col("part") % 3 != 0, _text("\nInsurer: ", _pick(PAYER_NAMES, F.col("part") % 4))
    ).otherwise("")
    body = _text(
        "Detail — ", _us(F.col("first_ship")), " to ", _us(F.col("last_ship")), " | ", F.col("n").cast("string"),
        " TREATMENTS | Claim: CLM", F.col("k").cast("string"), insurer,
    )
    return body, _text(
        "Period Total Charges: ", _money(F.col("total")), "\nIns Paid: ", _money(F.col("paid")),
        "\nContractual Adj. (", _money(F.col("adj")), ")\nEnding Balance: ", _money(F.col("open")),
    )


def _pharmacy_block() -> tuple[Column, Column]:
    fill = lambda s: _text(
        _us(s["first_ship"]), " ", (F.col("k") % 9000000 + 1000000).cast("string"),
        " Ramipril 5mg 40118-0932-75 STRAND OLE 56 28 ", _money(s["amount"]), " ",
        _pick(PARTY_NAMES, s["part"] % len(PARTY_NAMES)), " (BIN 550071)",
    )
    lines = F.transform("lines", fill)
    all_but_last = F.slice(lines, F.lit(1), F.greatest(F.size(lines) - 1, F.lit(0)))
    split = F.col("split") & (F.size(lines) > 1)
    body = F.when(split, F.array_join(all_but_last, "\n")).otherwise(F.array_join(lines, "\n"))
    return body, F.when(split, F.element_at(lines, -1))


_BLOCKS = {
    "claim": _claim_block, "account": _account_block, "admission": _admission_block,
    "inpatient": _inpatient_block, "dialysis": _dialysis_block, "pharmacy": _pharmacy_block,
}
_HEADINGS = {
    "claim": "Copies for the file\nRECORDS CUSTODIAN:\nALDER GROVE CLINIC, PC (Billing Records)",
    "account": "Pinecrest Scan Partners, Inc. Patient Billing Statement\nPatient Name Date of Birth Insurance\n"
    "Mads Elgin 12/08/1959 Lantern Bay Coverage",
    "admission": "Harrow Lane Care Patient Account Statement\nInsurance: Cedar Mutual Plan",
    "inpatient": "MERCY HOSPITAL\nPayer: Harbor Life (HL 22)",
    "dialysis": "Kidney Partners Patient Billing Statement",
    "pharmacy": "Juniper Street Pharmacy Pharmacy Expense Report\n"
    "Date Rx # Drug NDC Prescriber Qty Days Charge 3rd Party",
    "prose": "Minutes of the gardening club.",
}
MIXED_LAYOUTS = ["claim", "account", "admission", "inpatient", "dialysis", "pharmacy", "prose"]


def ledger_pages(spark: SparkSession, folder: str, layout: str | None = None) -> DataFrame:
    """Orders printed as ledger documents of eight orders each: ``pages(doc_id, page_num, page_content)``.

    Page 1 is a heading; three orders fill a page, and the third one ends on the next page. Without a layout,
    documents take turns through all of them. The pages stay where their document was gathered.
    """
    orders = order_totals(spark, folder)
    kind = F.lit(layout) if layout else _pick(MIXED_LAYOUTS, F.col("doc") % len(MIXED_LAYOUTS))
    orders = orders.withColumn("layout", kind)
    wanted = [layout] if layout else list(_BLOCKS)
    body, ending = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name in wanted:
        top, bottom = _BLOCKS[name]()
        body = body.when(F.col("layout") == name, top)
        ending = ending.when(F.col("layout") == name, bottom)
    printed = orders.select(
        "doc", "k", "layout", "page", "split", "total", "paid", "open", body.alias("body"), ending.alias("ending")
    ).withColumn("body", F.coalesce("body", F.lit("prose")))
    whole = F.array(F.struct("page", "k", F.concat_ws("\n", "body", "ending").alias("text")))
    halves = F.array(
        F.struct("page", "k", F.col("body").alias("text")),
        F.struct((F.col("page") + 1).alias("page"), "k", F.col("ending").alias("text")),
    )
    printed = printed.withColumn("parts", F.when(F.col("split") & F.col("ending").isNotNull(), halves).otherwise(whole))
    documents = printed.groupBy("doc").agg(
        F.first("layout").alias("layout"),
        F.sort_array(F.flatten(F.collect_list("parts"))).alias("parts"),
        F.sum("total").alias("total"),
        F.sum("paid").alias("paid"),
        F.sum("open").alias("open"),
    )
    heading = F.element_at(F.create_map(*[F.lit(x) for item in _HEADINGS.items() for x in item]), F.col("layout"))
    numbers = F.sort_array(F.array_distinct(F.transform("parts", lambda p: p["page"])))
    texts = F.transform(
        numbers,
        lambda n: F.struct(
            n.alias("page_num"),
            F.array_join(F.transform(F.filter("parts", lambda p: p["page"] == n), lambda p: p["text"]), "\n").alias(
                "page_content"
            ),
        ),
    )
    first = F.array(F.struct(F.lit(1).alias("page_num"), heading.alias("page_content")))
    summary = _text(
        "Payment Summary\nPatient Paid ", _money(F.col("open")), "\nInsurance Paid ", _money(F.col("paid")),
        "\nOthers (Third Parties) $0.00\nGrand Total ", _money(F.col("total")),
    )
    last = F.when(
        F.col("layout") == "pharmacy",
        F.array(F.struct(F.lit(9).alias("page_num"), summary.alias("page_content"))),
    ).otherwise(F.array().cast("array<struct<page_num:int,page_content:string>>"))
    return documents.select(F.col("doc").cast("string").alias("doc_id"), F.inline(F.concat(first, texts, last)))
