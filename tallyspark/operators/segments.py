"""Documents as pages in order: facts of a document, and its segments, without ever joining its pages to one text.

Plan shape: one scan turns every page into facts a few bytes long; blocks of ``OFFSET_BLOCK`` pages add them up, and a
scan over blocks gives what lies before each block and what holds for the document. The texts cross one shuffle by
document and block, are cut at the markers of their layout, and a second one that brings the parts of a segment together.
No row holds more than a segment. A marker, and a label with its value, are read within one page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark import fixed
from tallyspark.functions.payers import clean_payer
from tallyspark.functions.providers import clean_provider
from tallyspark.functions.text import blank_to_null, first_match, has, let, rx, strip
from tallyspark.operators.pages import OFFSET_BLOCK
from tallyspark.session import stored

CLAIM, ACCOUNT, ADMISSION = "claim", "account", "admission"
INPATIENT, DIALYSIS, PHARMACY = "inpatient", "dialysis", "pharmacy"

# marker that opens a segment, and whether blanks may come before it
MARKERS = {
    CLAIM: (fixed.CLAIM_MARKER, True),
    ACCOUNT: (fixed.ACCOUNT_MARKER, True),
    ADMISSION: (fixed.ADMISSION_MARKER, False),
    INPATIENT: (fixed.INPATIENT_MARKER, False),
    DIALYSIS: (fixed.DIALYSIS_MARKER, False),
}
# what a marker needs, lower-cased
_MARKER_WORDS = {
    CLAIM: "claim", ACCOUNT: "account", ADMISSION: "admission:", INPATIENT: "inpatient episode:", DIALYSIS: "treatment",
}
INDENTED = [name for name, (_, indented) in MARKERS.items() if indented]
NO_NUMBER = -(1 << 40)  # block of the pages without a number, which come first
NO_DOCUMENT = "\x00"  # key of the pages without a document, which are one document
HEAD = 200  # code points of a text that tell the order of pages of one number where the text itself is not at hand


def marker_line(layout: str) -> str:
    marker, indented = MARKERS[layout]
    return rf"[^\S\n]*{marker}" if indented else marker


def by_layout(choices: dict[str, Column], otherwise: Column | None = None) -> Column:
    chain = F.when(F.lit(False), None)
    for name, value in choices.items():
        chain = chain.when(F.col("layout") == name, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _page_tests(text: Column, low: Column) -> dict[str, Column]:
    """What a page says about the layout and payer of its document; a document has what one of its pages has.

    A plain search for a word that a pattern needs spares most pages the pattern.
    """
    words = lambda phrases: _any([text.contains(p) for p in phrases])
    tests = {
        "claim": low.contains("claim total:") & has(text, fixed.CLAIM_TOTAL, "im"),
        "account": words(fixed.ACCOUNT_WORDS),
        "dialysis": low.contains("period total") & _any([has(text, p, "im") for p in fixed.DIALYSIS_TOTALS]),
        "pharmacy": words(fixed.PHARMACY_NAMES),
        "fills": words(fixed.PHARMACY_TABLES),
        "not_unnamed": low.contains("insurance pa") & has(text, fixed.UNNAMED_PAYER_EXCEPT, "i"),
    }
    for kind, phrases in (("admission", fixed.ADMISSION_WORDS), ("inpatient", fixed.INPATIENT_WORDS)):
        tests |= {f"{kind}{i}": text.contains(p) for i, p in enumerate(phrases)}
    needed = ("insurance", "payment")
    return tests | {
        f"unnamed{i}": low.contains(needed[i]) & has(text, p, "i") for i, p in enumerate(fixed.UNNAMED_PAYER_WORDS)
    }


def _page_names(text: Column, low: Column) -> dict[str, Column]:
    """Names as the page prints them first; of a document the first page's count."""
    when = lambda word, value: F.when(low.contains(word), value)
    return {
        "custodian": when("records custodian:", first_match(text, fixed.CUSTODIAN, 1, "im")),
        "heading": first_match(text, r"(\S[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*)"),
        "label": F.when(low.contains("ins") | low.contains("payer"), first_match(text, fixed.PAYER_LABEL, 1, "im")),
        "table": when("patient name", first_match(text, fixed.PAYER_TABLE, 1, "im")),
        "inline": when("insurance", first_match(text, fixed.PAYER_INLINE, 1, "im")),
    }


def _bits(tests) -> Column:
    """Tests as the bits of one number, which adds up faster than as many columns."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)])


def _layout(is_true) -> Column:
    both = lambda kind, phrases: reduce(lambda a, b: a & b, [is_true(f"{kind}{i}") for i in range(len(phrases))])
    return (
        F.when(is_true("claim"), CLAIM)
        .when(is_true("account"), ACCOUNT)
        .when(both("admission", fixed.ADMISSION_WORDS), ADMISSION)
        .when(both("inpatient", fixed.INPATIENT_WORDS), INPATIENT)
        .when(is_true("dialysis"), DIALYSIS)
        .when(is_true("pharmacy") & is_true("fills"), PHARMACY)
    )


def _placed(pages: DataFrame) -> DataFrame:
    """Pages with their block and their place in it; pages of one number go by their text."""
    text = F.coalesce("page_content", F.lit(""))
    block = F.coalesce(F.expr(f"CAST(page_num AS BIGINT) div {OFFSET_BLOCK}"), F.lit(NO_NUMBER))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_DOCUMENT))
    return pages.select(named.alias("doc_id"), "page_num", text.alias("text"), block.alias("block"), F.length(text).alias("size"))


def _document_id() -> Column:
    return F.nullif("doc_id", F.lit(NO_DOCUMENT)).alias("doc_id")


def _solid(text: Column) -> Column:
    """Length of a text up to the end of its last line that is not blank; null when there is none."""
    blanks = F.length(F.regexp_extract(text, rx(r"^\s+\z", "m"), 0))
    return F.when(has(text, r"\S"), F.length(text) - blanks)


def _blocks(pages: DataFrame) -> DataFrame:
    """Per block: what lies before it in its document, and layout, names and size of the document."""
    text, low = F.col("text"), F.col("low")
    placed = _placed(pages).withColumn("low", F.lower("text"))
    tests, names = _page_tests(text, low), _page_names(text, low)
    count = lambda name: F.regexp_count(text, F.lit(rx(f"(?=^{marker_line(name)})", "im"))).cast("long")
    marks = {name: F.when(low.contains(word), count(name)).otherwise(F.lit(0)) for name, word in _MARKER_WORDS.items()}
    facts = placed.select(
        "doc_id", "block", F.struct("page_num", F.left("text", F.lit(HEAD)).alias("head")).alias("place"),
        (F.col("size") + 1).cast("long").alias("size"), _solid(F.concat(text, F.lit("\n"))).cast("long").alias("solid"),
        _bits(tests.values()).alias("tests"),
        *[value.alias(f"name_{name}") for name, value in names.items()],
        *[value.alias(f"marks_{name}") for name, value in marks.items()],
    )
    earlier = Window.partitionBy("doc_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("size").over(earlier), F.lit(0))
    first = lambda c: F.min_by(F.struct("place", F.col(c).alias("name")), F.when(F.col(c).isNotNull(), F.col("place")))
    sums = facts.withColumn("solid", F.col("solid") + begin).groupBy("doc_id", "block").agg(
        F.sum("size").alias("size"), F.max("solid").alias("solid"), F.count(F.lit(1)).alias("pages"),
        F.bit_or("tests").alias("tests"),
        *[first(f"name_{name}").alias(f"name_{name}") for name in names],
        *[F.sum(f"marks_{name}").alias(f"marks_{name}") for name in marks],
    )
    document, before = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("block")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    known = sums.select(
        "doc_id", "block", "size", "solid",
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"),
        (F.sum("size").over(document) - 1).alias("doc_size"),
        F.sum("pages").over(document).alias("pages"),
        F.first("block").over(document.orderBy("block")).alias("first_block"),
        F.bit_or("tests").over(document).alias("tests"),
        *[F.min(f"name_{name}").over(document)["name"].alias(f"name_{name}") for name in names],
        *[F.coalesce(F.sum(f"marks_{name}").over(before), F.lit(0)).alias(f"marks_{name}") for name in marks],
    )
    place_of = {name: 1 << i for i, name in enumerate(tests)}
    is_true = lambda name: F.col("tests").bitwiseAND(F.lit(place_of[name])) != 0
    heading = F.regexp_replace(strip(F.col("name_heading")), rx(fixed.STATEMENT_SUFFIX, "i"), "")
    provider = F.coalesce(
        blank_to_null(clean_provider(F.coalesce("name_custodian", F.lit("")))), clean_provider(heading), F.lit("")
    )
    unnamed = is_true("unnamed0") & is_true("unnamed1") & ~is_true("not_unnamed")
    payer = F.coalesce(
        *[clean_payer(F.col(f"name_{c}")) for c in ("label", "table", "inline")], F.when(unnamed, fixed.UNNAMED_PAYER)
    )
    return known.select(
        "doc_id", "block", "base", "doc_size", "pages", (F.col("block") == F.col("first_block")).alias("is_first"),
        F.coalesce(F.max(F.col("base") + F.col("solid")).over(before), F.lit(0)).alias("solid_before"),
        _layout(is_true).alias("layout"), provider.alias("provider"), payer.alias("document_payer"),
        *[F.col(f"marks_{name}") for name in marks],
    )


def _within(blocks: DataFrame, max_pages: int | None) -> DataFrame:
    """Blocks with ``too_long`` set and no layout for documents of more pages than the limit."""
    too_long = F.lit(False) if max_pages is None else F.col("pages") > max_pages
    shared = F.col("layout").isin(ACCOUNT, ADMISSION, INPATIENT)
    return (
        blocks.withColumn("too_long", too_long)
        .withColumn("layout", F.when(~F.col("too_long"), F.col("layout")))
        .withColumn("provider", F.when(F.col("layout").isNotNull(), F.col("provider")))
        .withColumn("document_payer", F.when(shared, F.col("document_payer")))
    )


def document_blocks(pages: DataFrame) -> DataFrame:
    """What blocks of pages hold, stored for those who ask for documents and for segments."""
    return stored(_blocks(pages), "blocks")


def document_facts(pages: DataFrame, max_pages: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """``doc_id, layout, provider, document_payer, too_long``: one row per document, whatever its number of pages.

    With ``max_pages`` a document of more pages is refused whole: ``too_long``, with no layout. ``blocks`` of these pages
    are taken if given.
    """
    blocks = _within(_blocks(pages) if blocks is None else blocks, max_pages).where("is_first")
    return blocks.select(_document_id(), "layout", "provider", "document_payer", "too_long")


def segments_of(pages: DataFrame, max_pages: int | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """``doc_id, seg, segment, layout, provider, document_payer, page``: one row per segment of a known layout.

    A segment goes from its marker to the next one, over any number of pages; what comes before the first marker is in
    none. Blank lines ahead of an indented marker belong to its segment. ``page`` names the pages that the segment has
    text on, as ``3`` or ``3-5``. A pharmacy document is one segment.
    """
    bases = _within(_blocks(pages) if blocks is None else blocks, max_pages).where(F.col("layout").isNotNull())
    bases = bases.withColumn("marks", by_layout({name: F.col(f"marks_{name}") for name in MARKERS}, F.lit(0)))
    bases = bases.select(
        F.col("doc_id").alias("b_doc"), F.col("block").alias("b_block"), "base", "doc_size", "solid_before", "layout",
        "provider", "document_payer", "marks",
    )
    rows = _placed(pages).join(bases, (F.col("doc_id") == F.col("b_doc")) & (F.col("block") == F.col("b_block")))
    in_block = Window.partitionBy("doc_id", "block")
    rows = rows.withColumn("place", F.row_number().over(in_block.orderBy("page_num", "text")))

    # the part of a page before its first marker goes on with the segment before; it may be empty
    def cut(name):
        opening = marker_line(name)
        parts = F.split("text", rx(f"(?=^{opening})", "im"), -1)
        leads = has(F.col("text"), rf"\A{opening}", "im")
        return F.when(leads, F.concat(F.array(F.lit("")), parts)).otherwise(parts)

    parts = by_layout({name: cut(name) for name in MARKERS}, F.array("text"))
    columns = [c for c in rows.columns if c not in ("text", "page_content", "b_doc", "b_block")]
    pieces = rows.withColumn("parts", parts).select(
        *columns, (F.size("parts") - 1).alias("last"), F.posexplode("parts").alias("i", "text")
    )
    is_last = F.col("i") == F.col("last")
    with_break = F.when(is_last, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    pieces = pieces.withColumns({"solid": _solid(with_break).cast("long"), "length": F.length(with_break).cast("long")})
    earlier = in_block.orderBy("place", "i").rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_block.orderBy("place", "i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.col("i") > 0
    pieces = pieces.withColumns(
        {
            "begin": F.col("base") + F.coalesce(F.sum("length").over(earlier), F.lit(0)),
            "seg": F.col("marks") + F.sum(opens.cast("long")).over(so_far) - 1,
        }
    ).withColumns(
        {
            "solid_before": F.greatest("solid_before", F.coalesce(F.max(F.col("begin") + F.col("solid")).over(earlier), F.lit(0))),
            "page_begin": F.first("begin").over(Window.partitionBy("doc_id", "block", "place").orderBy("i")),
        }
    )
    start = F.when(F.col("layout").isin(*INDENTED), F.col("solid_before")).otherwise(F.col("begin"))
    whole = F.col("layout") == PHARMACY
    page = F.struct(
        "page_num", F.col("page_begin").alias("begin"), (F.col("page_begin") + F.col("size")).alias("stop")
    )
    null = lambda kind: F.lit(None).cast(kind)
    trailing = F.col("solid").isNull() | (F.length(with_break) - F.col("solid") > 1)
    item = lambda seg, text, at, end, on: F.struct(
        seg.cast("long").alias("seg"), text.alias("text"), at.cast("long").alias("start"), end.cast("long").alias("end"),
        on.alias("page"),
    )
    own = item(
        F.when(whole, 0).otherwise(F.col("seg")), F.col("text"),
        F.when(whole, 0).when(opens, start), F.when(whole, F.col("doc_size")), page,
    )
    ends = F.when(opens, item(F.col("seg") - 1, null("string"), null("long"), start, F.when(F.lit(False), page)))
    # blank lines at the end of a page may belong to the next segment
    ahead = F.when(
        is_last & trailing & F.col("layout").isin(*INDENTED),
        item(F.col("seg") + 1, null("string"), null("long"), null("long"), page),
    )
    items = pieces.select(
        "doc_id", "block", "place", "layout", "provider", "document_payer", "doc_size",
        F.inline(F.array_compact(F.array(own, ends, ahead))),
    ).where("seg >= 0")
    written = F.when(F.col("text").isNotNull(), F.struct("block", "place", "text"))
    found = items.groupBy("doc_id", "seg").agg(
        F.array_join(F.sort_array(F.collect_list(written))["text"], "\n").alias("segment"),
        F.min("start").alias("start"),
        F.coalesce(F.max("end"), F.max("doc_size")).alias("end"),
        F.collect_list("page").alias("on"),
        *[F.max(c).alias(c) for c in ("layout", "provider", "document_payer")],
    )
    numbers = F.transform(
        F.filter("on", lambda p: p["page_num"].isNotNull() & (p["begin"] < F.col("end")) & (p["stop"] > F.col("start"))),
        lambda p: p["page_num"],
    )
    shown = let(
        F.struct(F.array_min(numbers).cast("string").alias("a"), F.array_max(numbers).cast("string").alias("b")),
        lambda x: F.when(x["a"].isNull(), "").when(x["a"] == x["b"], x["a"]).otherwise(F.concat(x["a"], F.lit("-"), x["b"])),
    )
    return found.where("start IS NOT NULL").select(
        _document_id(), "seg", "segment", "layout", "provider", "document_payer", shown.alias("page")
    )
