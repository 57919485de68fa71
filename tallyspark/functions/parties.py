"""Third-party payers named in pharmacy documents."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.functions.text import (
    all_matches, blank_to_null, distinct_ignoring_case, first_text, has, let, lines_of, rx, squeeze, strip,
)


def _empty() -> Column:
    return F.array().cast("array<string>")


def _cut_from(text: Column, markers: list[str]) -> Column:
    """Zero-based place of the earliest marker, or null."""
    places = F.array(*[F.instr(text, marker) for marker in markers])
    return F.array_min(F.filter(places, lambda p: p > 0)) - 1


def billing_section(text: Column) -> Column:
    """The fill table: from the first start marker to the first end marker after it."""
    tail = let(
        F.struct(text.alias("t"), _cut_from(text, fixed.PHARMACY_SECTION_START).alias("at")),
        lambda x: F.when(x["at"].isNotNull(), F.substring(x["t"], x["at"] + 1, F.length(x["t"]))),
    )
    section = let(
        tail,
        lambda t: F.substring(
            t, F.lit(1), F.coalesce(_cut_from(t, fixed.PHARMACY_SECTION_END), F.length(t))
        ),
    )
    return F.coalesce(section, text)


def lone_surnames(lines: Column) -> Column:
    """Capitalised surnames on their own line."""
    return F.filter(F.transform(lines, strip), lambda line: line.rlike(r"(?dU)^[A-Z][A-Z'-]{3,}\z"))


def prescriber_cells(line: Column) -> Column:
    """What stands between an item code and quantity and days: it ends in the prescriber's name."""
    return all_matches(line, fixed.PRESCRIBER_ROW)


def prescriber_words(cell: Column) -> Column:
    """The two last words of a prescriber cell if both are in capitals, else none."""
    pair = lambda w: F.slice(w, F.size(w) - 1, F.lit(2))
    upper = lambda w: (w == F.upper(w)) & (w != F.lower(w))
    return let(
        F.split(squeeze(cell), " "),
        lambda w: F.when((F.size(w) >= 2) & F.forall(pair(w), upper), pair(w)).otherwise(_empty()),
    )


def prescriber_tokens(lines: Column) -> Column:
    """Capitalised surnames on their own line, and the two name words before quantity and days."""
    stripped = F.transform(lines, strip)
    alone = lone_surnames(lines)
    cells = F.flatten(F.transform(stripped, prescriber_cells))
    # slice() starts at 1, so one-word cells are filtered before it
    several = F.filter(cells, lambda cell: squeeze(cell).contains(" "))
    return F.array_distinct(F.concat(alone, F.flatten(F.transform(several, prescriber_words))))


def drug_row_words(text: Column) -> Column:
    """Words between a date and an item code, lower-cased."""
    return F.flatten(F.transform(all_matches(text, fixed.DRUG_ROW), drug_name_words))


def drug_name_words(name: Column) -> Column:
    """Words of a drug name, lower-cased."""
    words = F.regexp_extract_all(name, F.lit("[A-Za-z]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.length(w) > 1), F.lower)


def drug_strength_words(text: Column) -> Column:
    """Words in front of a strength, lower-cased."""
    return F.transform(all_matches(text, fixed.DRUG_STRENGTH, 1, "i"), F.lower)


def drug_words(text: Column) -> Column:
    """Words that belong to drug names, lower-cased."""
    extra = F.array(*[F.lit(w) for w in fixed.DRUG_EXTRA_WORDS])
    return F.array_distinct(F.concat(drug_row_words(text), drug_strength_words(text), extra))


def fragment_words(line: Column) -> Column:
    """Words of a table line that are no codes, dates, money or doses; none for a heading."""
    text = F.regexp_replace(line, rx(r"\([^)]*\)"), " ")
    text = F.regexp_replace(text, rx(fixed.FRAGMENT_CLINICIAN), " ")
    text = F.regexp_replace(text, rx(fixed.FRAGMENT_TOKENS), " ")
    text = F.regexp_replace(text, rx(fixed.FRAGMENT_NUMBER, "i"), " ")
    text = F.regexp_replace(text, rx(fixed.FRAGMENT_UNIT, "i"), " ")
    bare = F.transform(
        F.split(squeeze(text), " "),
        lambda token: F.btrim(F.btrim(token, F.lit(fixed.FRAGMENT_EDGE_CHARS)), F.lit("-")),
    )
    words = F.filter(bare, lambda token: (token != "") & ~has(token, r"\d"))
    return F.when(~has(line, fixed.FRAGMENT_HEADER, "i"), words)


def party_fragment(line: Column, prescribers: Column | None, drugs: Column | None) -> Column:
    """What remains of a table line once codes, dates, money, doses and people are gone; null if nothing."""

    def kept(token: Column) -> Column:
        keep = token.isNotNull()
        if prescribers is not None:
            keep = keep & ~F.array_contains(prescribers, F.upper(token))
        if drugs is not None:
            keep = keep & ~F.array_contains(drugs, F.lower(token))
        return keep

    return blank_to_null(F.array_join(F.filter(fragment_words(line), kept), " "))


def without_codes(value: Column) -> Column:
    text = F.regexp_replace(squeeze(value), rx(fixed.PARTY_CODE), "")
    text = F.regexp_replace(text, rx(fixed.PARTY_CODE_TAIL), "")
    return F.btrim(text, F.lit(fixed.PAYER_EDGE_CHARS))


def plausible(name: Column) -> Column:
    """The name itself if a payer may be called so: five words or fewer, one short word of capitals; else null."""
    return F.when(name.rlike("^[A-Z]{2,}$"), F.when(F.length(name) <= 5, name)).when(
        ~has(name, r"\d") & (F.size(F.split(name, " ")) <= 5), name
    )


def party_name(value: Column, prescribers: Column | None = None, drugs: Column | None = None) -> Column:
    """A plausible payer name of at most five words, or null."""
    return let(party_fragment(without_codes(value), prescribers, drugs), plausible)


def detail_names(text: Column) -> Column:
    """Names listed in a payer detail section, or an empty list."""
    section = first_text(text, fixed.PARTY_DETAIL, 0, "is")
    rows = F.filter(
        F.transform(lines_of(section), squeeze),
        lambda row: (row != "") & ~has(row, fixed.PARTY_DETAIL_HEADER, "i") & has(row, fixed.MONEY),
    )
    names = F.transform(
        rows, lambda row: party_name(F.regexp_replace(row, rx(fixed.PARTY_DETAIL_END, "i"), ""))
    )
    return F.coalesce(distinct_ignoring_case(F.array_compact(names)), _empty())


def _names_before_bin(lines: Column, prescribers: Column, drugs: Column) -> Column:
    """Per BIN marker, the fragments of its line and up to four lines before it, past the previous marker."""
    markers = F.array_compact(
        F.transform(lines, lambda line, i: F.when(has(line, fixed.BIN_MARKER, "i"), i))
    )

    def fragment(line: Column) -> Column:
        return party_fragment(F.regexp_replace(line, rx(fixed.BIN_MARKER + ".*$", "i"), ""), prescribers, drugs)

    def names(at_markers: Column) -> Column:
        def one(index: Column, k: Column) -> Column:
            previous = F.when(k > 0, F.get(at_markers, k - 1)).otherwise(F.lit(-1))
            first = F.greatest(previous + 1, index - 4, F.lit(0))
            window = F.slice(lines, first + 1, index - first + 1)
            return F.array_join(F.array_compact(F.transform(window, fragment)), " ")

        return F.filter(F.transform(at_markers, one), lambda name: name != "")

    return let(markers, names)


def party_cell(row: Column) -> Column:
    """Of a squeezed fill row, the text of its party column, maybe empty; null for any other row."""
    tail = F.trim(first_text(row, rf"^.*?\b{fixed.ITEM_CODE}\b(.*)$"))
    is_fill = has(row, fixed.FILL_ROW) & has(row, rf"\b{fixed.ITEM_CODE}\b")
    return F.when(is_fill, first_text(tail, fixed.PARTY_COLUMN_TAIL))


def _names_in_party_column(text: Column, lines: Column, prescribers: Column, drugs: Column) -> Column:
    """Per fill row, the party cell, or the fragments of the lines above and below when it is empty."""

    def one(line: Column, i: Column) -> Column:
        def from_row(row: Column) -> Column:
            beside = F.concat_ws(
                " ",
                party_fragment(F.when(i > 0, F.get(lines, i - 1)), prescribers, drugs),
                party_fragment(F.get(lines, i + 1), prescribers, drugs),
            )
            named = lambda cell: F.coalesce(party_fragment(cell, prescribers, drugs), blank_to_null(beside))
            return let(party_cell(row), lambda cell: F.when(cell.isNotNull(), named(cell)))

        return let(squeeze(line), from_row)

    listed = F.array_compact(F.transform(lines, one))
    return F.when(has(text, fixed.PARTY_COLUMN_HEADER, "i"), listed).otherwise(_empty())


def _named(names: Column, prescribers: Column, drugs: Column) -> Column:
    """Plausible names in order; a name that occurs often is read once."""
    different = F.array_distinct(names)
    return let(
        F.map_from_arrays(different, F.transform(different, lambda name: party_name(name, prescribers, drugs))),
        lambda read: F.array_compact(F.transform(names, lambda name: F.element_at(read, name))),
    )


def _frequent(names: Column) -> Column:
    """Names seen often enough, first-seen order; long lists drop rare ones as reading noise."""

    def kept(all_names: Column) -> Column:
        total = F.size(all_names)
        least = F.when(
            total >= fixed.PARTY_LONG_LIST,
            F.greatest(F.lit(fixed.PARTY_MIN_COUNT), F.floor(total * fixed.PARTY_MIN_SHARE).cast("int")),
        ).otherwise(F.lit(1))
        often = lambda name: F.size(F.filter(all_names, lambda other: other == name)) >= least
        return distinct_ignoring_case(F.filter(F.array_distinct(all_names), often))

    return let(names, kept)


def _compact(names: Column) -> Column:
    """Drop names that are only a fragment of another one."""

    def kept(all_names: Column) -> Column:
        keys = F.transform(all_names, F.lower)

        def redundant(name: Column) -> Column:
            key = F.lower(name)
            words = F.split(key, " ")
            inside = F.exists(
                keys,
                lambda other: (other != key)
                & F.rlike(other, F.concat(F.lit(r"(?U)\b\Q"), key, F.lit(r"\E\b"))),
            )
            begins = F.exists(keys, lambda other: (other != key) & F.startswith(other, F.concat(key, F.lit(" "))))
            two_word = (F.size(words) == 2) & F.element_at(words, -1).isin(fixed.PARTY_FRAGMENT_ENDINGS)
            return F.when(F.size(words) == 1, inside).when(two_word, begins).otherwise(F.lit(False))

        return F.filter(all_names, lambda name: ~redundant(name))

    return let(names, kept)


def third_parties(text: Column, section: Column) -> Column:
    """Distinct third-party payers of a pharmacy document."""

    def from_table(t: Column) -> Column:
        bound = let(
            lines_of(t),
            lambda lines: F.struct(
                lines.alias("lines"),
                prescriber_tokens(lines).alias("prescribers"),
                drug_words(t).alias("drugs"),
            ),
        )

        def names(x: Column) -> Column:
            lines, people, drugs = x["lines"], x["prescribers"], x["drugs"]
            found = F.concat(
                _names_before_bin(lines, people, drugs), _names_in_party_column(t, lines, people, drugs)
            )
            return let(found, lambda names: _named(names, people, drugs))

        return _compact(_frequent(let(bound, names)))

    return let(
        detail_names(text),
        lambda listed: F.when(F.size(listed) > 0, listed).otherwise(let(section, from_table)),
    )
