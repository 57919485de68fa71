"""Third-party payers of pharmacy documents as relations, for documents of any length.

Lines are numbered by sums over blocks of pages. A name in front of a payer marker is an island of lines: each line
belongs to the next marker at most four lines below it. Windows run over blocks of lines that overlap by as many lines as
a line may look around, so no task holds a document. Words of people and drugs leave by a join with a document's distinct
words, names are counted per document, and fragments of other names leave by an anti-join with an index of their words.
What a document has many times, as a cell, a person or the words of a name, is made distinct before it is looked into.

Patterns are read within a line, but for a drug name and the heading of the party column, which may go on over the next two.
A null ``doc_id`` is a document like any other, a null text is an empty page, pages of one number stand in the order of
their texts, and a page given twice counts twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark import fixed
from tallyspark.functions.parties import (
    drug_name_words, drug_strength_words, fragment_words, party_cell, plausible, prescriber_cells, prescriber_words, without_codes,
)
from tallyspark.functions.text import all_matches, blank_to_null, first_match, has, lines_of, rx, squeeze
from tallyspark.session import stored

PAGE_BLOCK = 256
LINE_BLOCK = 4096
# lines that a payer's name may begin before its marker
REACH = 4
_BIN, _COLUMN, _DETAIL = 0, 1, 2


def _on(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of equally named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def _with_facts(rows: DataFrame, facts: DataFrame, *keys: str, how: str = "left") -> DataFrame:
    """``rows`` with the other columns of ``facts``, which has one row per key."""
    renamed = facts.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & rows[key].eqNullSafe(renamed[f"_{key}"])
    return rows.join(renamed, condition, how).drop(*[f"_{k}" for k in keys])


def document_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, line, text``: the lines of each document, numbered from 0 over all its pages."""
    placed = pages.select(
        "doc_id", "page_num", F.floor(F.col("page_num") / PAGE_BLOCK).alias("page_block"),
        F.coalesce("page_content", F.lit("")).alias("page_text"),
    )
    sizes = placed.groupBy("doc_id", "page_block").agg(F.sum(F.size(lines_of(F.col("page_text")))).alias("n"))
    ahead = Window.partitionBy("doc_id").orderBy("page_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("doc_id", "page_block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    before = Window.partitionBy("doc_id", "page_block").orderBy("page_num", "page_text").rowsBetween(Window.unboundedPreceding, -1)
    rows = _with_facts(placed, bases, "doc_id", "page_block", how="inner").withColumn(
        "first", F.col("base") + F.coalesce(F.sum(F.size(lines_of(F.col("page_text")))).over(before), F.lit(0))
    )
    return rows.select("doc_id", "first", F.posexplode(lines_of(F.col("page_text"))).alias("i", "text")).select(
        "doc_id", (F.col("first") + F.col("i")).alias("line"), "text"
    )


def _either(markers: list[str]) -> str:
    return "|".join(rf"\Q{marker}\E" for marker in markers)


def _place(pattern: str, flags: str = "") -> Column:
    """``(line, at)`` of the first match in the line, ``at`` from 0; null without one."""
    ahead = F.regexp_extract("text", rx(rf"\A(.*?)(?:{pattern})", flags + "s"), 1)
    return F.when(has(F.col("text"), pattern, flags), F.struct("line", F.length(ahead).cast("long").alias("at")))


def between(lines: DataFrame, start: str, stop: str, flags: str = "", otherwise_all: bool = False, likely: Column | None = None) -> DataFrame:
    """Lines from the first ``start`` of their document to the first ``stop`` after it, cut at both.

    A document without a start gives nothing, or all its lines if ``otherwise_all``. Two small aggregates find the places.
    ``likely`` is a plain search that spares most lines the patterns.
    """
    matched = has(F.col("text"), start, flags) | has(F.col("text"), stop, flags)
    marked = stored(lines.where(matched if likely is None else likely & matched), "marked-lines")
    starts = marked.groupBy("doc_id").agg(F.min(_place(start, flags)).alias("start")).where("start IS NOT NULL")
    follows = _with_facts(marked, starts, "doc_id", how="inner").where(F.col("line") >= F.col("start.line"))
    at = F.when(F.col("line") == F.col("start.line"), F.col("start.at")).otherwise(F.lit(0)).cast("int")
    tails = follows.withColumn("cut", at).withColumn("text", F.expr("substring(text, cut + 1)"))
    place = _place(stop, flags)
    places = F.when(place.isNotNull(), F.struct("line", (place["at"] + F.col("cut")).alias("at")))
    spans = tails.groupBy("doc_id").agg(F.first("start").alias("start"), F.min(places).alias("stop"))
    rows = _with_facts(lines, spans, "doc_id", how="left" if otherwise_all else "inner")
    inside = F.col("start").isNull() | (
        (F.col("line") >= F.col("start.line")) & (F.col("stop").isNull() | (F.col("line") <= F.col("stop.line")))
    )
    first = F.when(F.col("line") == F.col("start.line"), F.col("start.at")).otherwise(0)
    last = F.when(F.col("line") == F.col("stop.line"), F.col("stop.at")).otherwise(F.length("text"))
    cut = rows.where(inside).withColumns({"_from": F.coalesce(first, F.lit(0)), "_to": F.coalesce(last, F.length("text"))})
    return cut.select("doc_id", "line", F.expr("substring(text, int(_from) + 1, int(_to - _from))").alias("text"))


def _around(lines: DataFrame) -> DataFrame:
    """Lines with the line before, two lines after, and the payer marker that a line belongs to.

    A block of lines also gets the lines of its neighbours that its own lines look at; those are not given back.
    """
    block = F.floor(F.col("line") / LINE_BLOCK)
    place = F.col("line") % LINE_BLOCK
    copies = F.array_compact(
        F.array(block, F.when(place < REACH, block - 1), F.when(place == LINE_BLOCK - 1, block + 1))
    )
    spread = lines.withColumn("own", block).withColumn("line_block", F.explode(copies))
    in_block = Window.partitionBy("doc_id", "line_block").orderBy("line")
    marker = F.when(F.col("text").contains("(") & has(F.col("text"), fixed.BIN_MARKER, "i"), F.col("line"))
    return (
        spread.withColumn("marker", marker)
        .withColumns(
            {
                "above": F.lag("text").over(in_block),
                "below": F.lead("text").over(in_block),
                "below2": F.lead("text", 2).over(in_block),
                "target": F.min("marker").over(in_block.rowsBetween(Window.currentRow, REACH)),
            }
        )
        .where(F.col("own") == F.col("line_block"))
        .drop("own", "line_block", "marker")
    )


def _readings(lines: DataFrame) -> DataFrame:
    """Per line, what names its people and drugs, whether it heads a party column, and the texts that name a party on it.

    A plain search for what a pattern needs spares most lines the pattern. What goes on over the next lines is read where
    it begins. ``before`` has the words that stand before the marker of line ``target``; ``cell`` is the text of a fill
    row's party column, for which ``above`` and ``below`` count if no word of it does.
    """
    c = F.col
    text, low = c("text"), F.lower("text")
    together = F.concat_ws("\n", "text", "below", "below2")
    dated, priced = text.contains("/"), text.contains("$")
    # a fill row that names no party takes the lines above and below; which of them counts is known once words are gone
    around = _around(lines).withColumn("row", F.when(dated, squeeze(text)))
    around = around.withColumn("cell", F.when(c("row").isNotNull(), party_cell(c("row"))))
    before_marker = fragment_words(F.regexp_replace("text", rx(fixed.BIN_MARKER + ".*$", "i"), ""))
    dosed = low.contains("mg") | low.contains("mcg") | low.contains("ml")
    return around.select(
        "doc_id", "line", "target", "cell",
        F.when(priced, prescriber_cells(text)).alias("staff"),
        F.when(~priced, first_match(text, r"\A\s*([A-Z][A-Z'-]{3,})\s*\z")).alias("surname"),
        F.when(dated, all_matches(together, fixed.DRUG_ROW)).alias("drug_names"),
        F.when(dosed, drug_strength_words(text)).alias("dosed"),
        (low.contains("3rd party") & has(together, fixed.PARTY_COLUMN_HEADER, "i")).alias("heads"),
        F.when(c("target").isNotNull(), before_marker).alias("before"),
        F.when(c("cell").isNotNull(), c("above")).alias("above"),
        F.when(c("cell").isNotNull(), c("below")).alias("below"),
    )


def _unknown_words(rows: DataFrame, people: DataFrame, drugs: DataFrame) -> DataFrame:
    """``rows(doc_id, word, ...)`` whose word names neither a person nor a drug of its document."""
    words = rows.select("doc_id", "word").distinct()
    extra = [F.lit(w) for w in fixed.DRUG_EXTRA_WORDS]
    found = words.withColumns({"upper": F.upper("word"), "lower": F.lower("word")}).where(~F.col("lower").isin(*extra))
    found = found.join(people, found["doc_id"].eqNullSafe(people["doc_id"]) & (found["upper"] == people["person"]), "left_anti")
    found = found.join(drugs, found["doc_id"].eqNullSafe(drugs["doc_id"]) & (found["lower"] == drugs["drug"]), "left_anti")
    kept = found.select(F.col("doc_id").alias("_doc"), F.col("word").alias("_word"))
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept["_doc"]) & (rows["word"] == kept["_word"]), "left_semi")


def _left_names(places: DataFrame, people: DataFrame, drugs: DataFrame) -> DataFrame:
    """``doc_id, source, at, n, raw``: what people and drugs leave of ``places(doc_id, source, at, n, words)``, if anything."""
    words = _unknown_words(places.select("doc_id", "source", "at", "n", F.posexplode("words").alias("i", "word")), people, drugs)
    listed = F.sort_array(F.collect_list(F.struct("i", "word")))["word"]
    return words.groupBy("doc_id", "source", "at").agg(F.first("n").alias("n"), F.array_join(listed, " ").alias("raw"))


def _table_names(lines: DataFrame) -> DataFrame:
    """``doc_id, name, n, first``: plausible names in the fill tables, how often and where they stand first."""
    read = stored(_readings(lines), "party-lines")
    staff = read.select("doc_id", F.explode("staff").alias("cell")).distinct().where(squeeze(F.col("cell")).contains(" "))
    people = staff.select("doc_id", F.explode(prescriber_words(F.col("cell"))).alias("person"))
    people = people.unionAll(read.where("surname IS NOT NULL").select("doc_id", "surname")).distinct()
    drugs = read.select("doc_id", F.explode("drug_names").alias("name")).distinct()
    drugs = drugs.select("doc_id", F.explode(drug_name_words(F.col("name"))).alias("drug"))
    drugs = drugs.unionAll(read.select("doc_id", F.explode("dosed"))).distinct()
    headed = read.where("heads").select(F.col("doc_id").alias("_doc")).distinct()
    in_column = read.where("cell IS NOT NULL").select("doc_id", "line", "cell", "above", "below")
    in_column = in_column.join(headed, in_column["doc_id"].eqNullSafe(headed["_doc"]), "left_semi")
    # places of a text or of a list of words are counted first, so each is looked into once in a document; the first
    # place tells them apart from then on
    cells = in_column.groupBy("doc_id", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("at"))
    cells = stored(cells.withColumn("words", fragment_words(F.col("cell"))), "party-cells")
    in_cell = _left_names(cells.withColumn("source", F.lit(_COLUMN)), people, drugs)
    in_cell = stored(in_cell, "party-cell-names")
    empty = cells.select("doc_id", "cell", "at").join(in_cell.select("doc_id", "at"), _on(cells, in_cell, "doc_id", "at"), "left_anti")
    empty = stored(empty.select("doc_id", "cell"), "empty-cells")
    beside = in_column.join(empty, _on(in_column, empty, "doc_id", "cell"), "left_semi")
    none = F.array().cast("array<string>")
    both = [F.coalesce(fragment_words(F.col(side)), none) for side in ("above", "below")]
    beside = beside.select("doc_id", F.lit(_COLUMN).alias("source"), F.col("line").alias("at"), F.concat(*both).alias("words"))
    # five lines at most make a name
    pieces = read.where("target IS NOT NULL").groupBy("doc_id", F.col("target").alias("at"))
    pieces = pieces.agg(F.sort_array(F.collect_list(F.struct("line", F.coalesce("before", none).alias("words")))).alias("pieces"))
    ahead = pieces.select("doc_id", F.lit(_BIN).alias("source"), "at", F.flatten(F.col("pieces.words")).alias("words"))
    places = ahead.unionByName(beside).groupBy("doc_id", "source", "words")
    places = stored(places.agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at")), "party-words")
    names = in_cell.unionByName(_left_names(places, people, drugs))
    names = names.select("doc_id", "raw", "n", F.struct("source", "at").alias("first"))
    raw = names.groupBy("doc_id", "raw").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    words = raw.select("doc_id", "raw", "n", "first", F.posexplode(fragment_words(without_codes(F.col("raw")))).alias("i", "word"))
    named = _unknown_words(words, people, drugs).groupBy("doc_id", "raw").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("i", "word")))["word"], " ").alias("name"),
        F.first("n").alias("n"), F.first("first").alias("first"),
    )
    named = named.withColumn("name", plausible(blank_to_null(F.col("name")))).where("name IS NOT NULL")
    return named.groupBy("doc_id", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _first_spelling(names: DataFrame) -> DataFrame:
    """One row per name whatever its case, spelled as where it stands first; mentions of all spellings add up."""
    same = names.groupBy("doc_id", F.lower("name").alias("key"))
    spelled = same.agg(F.min_by("name", F.struct("first", "name")).alias("name"), F.sum("n").alias("n"), F.min("first").alias("first"))
    return spelled.drop("key")


def frequent(names: DataFrame) -> DataFrame:
    """Names seen often enough: in a document of many mentions, three times and in three percent of them."""
    totals = names.groupBy("doc_id").agg(F.sum("n").alias("total"))
    share = F.floor(F.col("total") * F.lit(fixed.PARTY_MIN_SHARE))
    least = F.when(F.col("total") >= fixed.PARTY_LONG_LIST, F.greatest(F.lit(fixed.PARTY_MIN_COUNT), share)).otherwise(1)
    return _with_facts(names, totals, "doc_id").where(F.col("n") >= least).drop("total")


def without_fragments(names: DataFrame) -> DataFrame:
    """``names(doc_id, name, ...)`` without those that are only a fragment of another name of their document.

    A one-word name is a fragment if another name holds it as a whole word, a name of two words that ends in one of the
    fixed endings if another one goes on after it; case does not count. Possible fragments look themselves up in an index of
    words, so names are never compared in pairs; all others stay where they are. For a name of word characters only, and
    for one of two words, the entry alone decides, so entries are distinct and hold no names. Any other one-word name, as
    ``O'Dell``, is looked for in the names that have a word of such a mixed kind. ``names`` are not null, and are read
    several times: store them.
    """
    key = F.lower("name")
    words = F.split(key, " ")
    # word characters and spaces only, as in most names: the words are what lies between the spaces
    simple = ~key.rlike(r"(?U)[^\w ]")
    single = ~key.contains(" ")
    plain = simple & single & (key != "")
    ending = lambda word: word.isin(fixed.PARTY_FRAGMENT_ENDINGS)
    pair = (F.size(words) == 2) & ending(F.element_at(words, -1))
    # join keys as columns, so that distinct entries and the join share an exchange
    document = [F.coalesce("doc_id", F.lit("")).alias("_doc"), F.col("doc_id").isNull().alias("_none")]
    on = ["_doc", "_none", "_word"]
    runs = lambda text, kind: F.regexp_extract_all(text, F.lit(f"(?U){kind}"), F.lit(0))

    # a name's own text is no entry: only another name may hold it
    held = F.filter(F.when(simple, words).otherwise(runs(key, r"\w+")), lambda run: (run != key) & (run != ""))
    begun = F.when((F.size(words) > 2) & ending(F.get(words, 1)), F.array(F.array_join(F.slice(words, 1, 2), " ")))
    # the outer form: for the plain one the planner makes the list a second time, to leave out empty ones
    every = F.explode_outer(F.concat(held, F.coalesce(begun, F.array())))
    entries = names.where(~plain).select(*document, every.alias("_word")).where("_word IS NOT NULL").distinct()
    asked = names.where(F.when(single, plain).otherwise(pair)).select("*", *document, key.alias("_word"))
    looked_up = asked.join(entries, on, "left_anti")

    mixed = F.filter(words, lambda word: word.rlike(r"(?U)\w") & word.rlike(r"(?U)\W"))
    pieces = F.explode_outer(F.array_distinct(F.flatten(F.transform(mixed, lambda word: runs(word, r"\w+|\W+")))))
    within = names.where(~simple).select(*document, key.alias("_other"), pieces.alias("_word"))
    within = within.where("_word IS NOT NULL")
    spelled = F.regexp_extract(key, r"(?U)\w+", 0)
    odd = names.where(single & ~plain).select(
        "*", *document, F.when(spelled != "", spelled).otherwise(key).alias("_word"), key.alias("_key")
    )
    holds = F.rlike(F.col("_other"), F.concat(F.lit(r"(?U)\b\Q"), F.col("_key"), F.lit(r"\E\b")))
    same = (F.col("_key") != F.col("_other")) & holds
    for name in on:
        same = (odd[name] == within[name]) & same
    searched = odd.join(within, same, "left_anti")

    rest = names.where(F.coalesce(~single & ~pair, F.lit(True)))
    return rest.unionByName(looked_up.select(names.columns)).unionByName(searched.select(names.columns))


def _detail_names(lines: DataFrame) -> DataFrame:
    """Names listed in the payer details of a document, where it has such a section."""
    # without the letters i, k and s, which stand for others when case does not count
    low = F.lower("text")
    likely = low.contains("party payer") | low.contains("payment") | low.contains("grand total") | low.contains("page")
    section = between(
        lines, r"Third[- ]Party Payer Detail(?=\s|$)", r"Payment Summary|Grand Total|Page\s+\d+", "i", likely=likely
    )
    rows = section.select("doc_id", "line", squeeze(F.col("text")).alias("row")).where(
        (F.col("row") != "") & ~has(F.col("row"), fixed.PARTY_DETAIL_HEADER, "i") & has(F.col("row"), fixed.MONEY)
    )
    value = F.regexp_replace("row", rx(fixed.PARTY_DETAIL_END, "i"), "")
    name = plausible(blank_to_null(F.array_join(fragment_words(without_codes(value)), " ")))
    named = rows.select("doc_id", "line", name.alias("name")).where("name IS NOT NULL")
    place = F.struct(F.lit(_DETAIL).alias("source"), F.col("line").alias("at"))
    return named.groupBy("doc_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))


def third_parties(pages: DataFrame) -> DataFrame:
    """``doc_id, name, n, first``: the distinct third-party payers of pharmacy documents, a row each.

    ``n`` counts mentions, ``first`` is the place that orders the names of a document. A payer detail section is taken as it
    is; without one the names come from the fill tables, rare ones and fragments left out.
    """
    # lines are looked at several times; their numbers cost two exchanges of the texts
    lines = stored(document_lines(pages), "lines")
    detail = stored(_first_spelling(_detail_names(lines)), "party-details")
    start, stop = _either(fixed.PHARMACY_SECTION_START), _either(fixed.PHARMACY_SECTION_END)
    markers = [F.col("text").contains(m) for m in fixed.PHARMACY_SECTION_START + fixed.PHARMACY_SECTION_END]
    table = between(lines, start, stop, otherwise_all=True, likely=reduce(Column.__or__, markers))
    listed = detail.select(F.col("doc_id").alias("_doc")).distinct()
    table = table.join(listed, table["doc_id"].eqNullSafe(listed["_doc"]), "left_anti")
    names = stored(_first_spelling(frequent(_table_names(table))), "party-names")
    return detail.unionByName(without_fragments(names))
