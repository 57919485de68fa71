"""Who paid: payer names out of labels, service blocks and neighbouring table cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.fixed import DATE, MONEY
from tallyspark.functions.text import (
    all_matches, blank_to_null, first_text, has, let, rx, squeeze, strip,
)


def clean_payer(name: Column) -> Column:
    """The bare name, or null when nothing usable is left."""
    cut = F.regexp_replace(squeeze(name), rx(fixed.PAYER_STOP + ".*", "i"), "")
    bare = F.regexp_replace(F.btrim(cut, F.lit(fixed.PAYER_EDGE_CHARS)), rx(fixed.PAYER_CODE_SUFFIX), "")
    return let(
        bare,
        lambda v: F.when((v != "") & ~F.lower(v).isin(fixed.PAYER_GENERIC) & ~has(v, r"\d"), v),
    )


def labelled_payer(text: Column) -> Column:
    """The payer after a label; a plain search for letters that have one case pair only spares most texts the pattern."""
    found = lambda pattern: clean_payer(first_text(text, pattern, 1, "im"))
    low = F.lower(text)
    return F.coalesce(
        F.when(text.contains(":"), found(fixed.PAYER_LABEL)),
        F.when(text.contains("/") & low.contains("ent name"), found(fixed.PAYER_TABLE)),
        F.when(low.contains("uran"), found(fixed.PAYER_INLINE)),
    )


def unnamed_payer(text: Column) -> Column:
    insurance, payment = fixed.UNNAMED_PAYER_WORDS
    return F.when(
        has(text, insurance, "i") & has(text, payment, "i") & ~has(text, fixed.UNNAMED_PAYER_EXCEPT, "i"),
        fixed.UNNAMED_PAYER,
    )


def payer_in(text: Column) -> Column:
    """Payer of a whole document or segment."""
    return F.coalesce(labelled_payer(text), unnamed_payer(text))


# One or more pairs of all-capital words (a clinician's name) at the end of the text.
_CAPITAL_WORD = r"(?=\S*\p{Lu})[^\s\p{Ll}]+"
_TRAILING_NAMES = rf"(?:(?:^|\s){_CAPITAL_WORD}\s{_CAPITAL_WORD})+$"


def _ends_with_word(text: Column, tail: Column) -> Column:
    before = F.substring(text, F.length(text) - F.length(tail), F.lit(1))
    apart = (F.length(text) == F.length(tail)) | ~has(before, r"\w")
    return F.endswith(F.lower(text), F.lower(tail)) & apart


def payer_after_slash(block: Column) -> Column:
    """``service / Payer $amount`` where the payer may go on after the amount."""

    def parts(flat: Column) -> Column:
        marked = first_text(flat, fixed.PAYER_SLASH)
        cut = F.trim(F.regexp_replace(marked, rx(fixed.CLAIM_ROW_INSIDE + ".*"), ""))
        return F.struct(
            (marked != "").alias("is_marked"),
            F.trim(F.regexp_replace(cut, rx(_TRAILING_NAMES), "")).alias("head"),
            strip(first_text(flat, fixed.PAYER_CONTINUED, 1, "i")).alias("tail"),
            flat.alias("flat"),
        )

    def chosen(found: Column) -> Column:
        head, tail = found["head"], found["tail"]
        joined = (
            F.when(tail == "", head)
            .when(clean_payer(head).isNull(), tail)
            .when(_ends_with_word(head, tail), head)
            .otherwise(F.concat(head, F.lit(" "), tail))
        )
        wrapped = first_text(found["flat"], fixed.PAYER_SLASH_WRAPPED, 1, "i")
        unmarked = let(wrapped, lambda w: F.when(w != "", w).otherwise(tail))
        return F.when(found["is_marked"], joined).otherwise(unmarked)

    return clean_payer(let(let(squeeze(block), parts), chosen))


def _last_title_name(text: Column) -> Column:
    return F.try_element_at(all_matches(text, fixed.TITLE_NAME, 0), F.lit(-1))


def _name_in_cell_line(line: Column) -> Column:
    def named(text: Column) -> Column:
        skip = (text == "") | has(text, f"{DATE}|{MONEY}") | has(text, fixed.COLUMN_NOISE, "i")
        without = strip(F.regexp_replace(text, rx(fixed.COLUMN_CLINICIAN), ""))
        title_end = has(text, r"\b[a-z]+\b") & has(text, r"\b[A-Z][a-z]{2,}\b$")
        return F.when(
            ~skip,
            F.coalesce(
                let(without, lambda w: F.when(w != text, _last_title_name(w))),
                F.when(title_end, _last_title_name(text)),
            ),
        )

    return let(strip(line), named)


def _nearest_name(lines: Column) -> Column:
    return F.get(F.array_compact(F.transform(lines, _name_in_cell_line)), F.lit(0))


def payer_beside(before: Column, after: Column) -> Column:
    """Payer from table cells wrapped around the charge line; both lists run away from that line."""

    def joined(pair: Column) -> Column:
        same = F.lower(pair["a"]) == F.lower(pair["b"])
        return clean_payer(
            F.when(same, pair["a"]).otherwise(blank_to_null(F.concat_ws(" ", pair["a"], pair["b"])))
        )

    return let(F.struct(_nearest_name(before).alias("a"), _nearest_name(after).alias("b")), joined)


def payer_of_charge_line(lines: Column, index: Column, block_ends: Column) -> Column:
    """Payer of the charge line at zero-based ``index``; ``block_ends`` are the lines that close a block."""
    size = F.size(lines)

    def found(stop: Column) -> Column:
        start = F.greatest(index - 2, F.lit(0))
        block = F.array_join(F.slice(lines, start + 1, stop - start), "\n")
        first = F.greatest(index - 3, F.lit(0))
        before = F.reverse(F.slice(lines, first + 1, index - first))
        after = F.slice(lines, index + 2, F.lit(3))
        in_block = let(
            block, lambda b: F.coalesce(labelled_payer(b), payer_after_slash(b), unnamed_payer(b))
        )
        return F.coalesce(in_block, payer_beside(before, after))

    next_end = F.array_min(F.filter(block_ends, lambda e: e > index))
    return let(F.coalesce(next_end, size), found)


def claim_payer(segment_lines: Column, claim_id: Column) -> Column:
    """Payer of the first charge line of a claim that names one."""
    row = rf"^\s*(\d+)\s+{fixed.CODE}\s+{DATE}\s+.*?\bCHARGE\b"
    end = rx(fixed.CLAIM_BLOCK_END, "i")

    def positions(lines: Column, test) -> Column:
        marked = F.transform(lines, lambda line, i: F.when(test(line), i))
        return F.array_compact(marked)

    def searched(lines: Column) -> Column:
        ends = positions(lines, lambda line: line.rlike(end))
        rows = positions(lines, lambda line: first_text(line, row, 1, "i") == claim_id)
        return let(
            ends,
            lambda stops: F.aggregate(
                rows,
                F.lit(None).cast("string"),
                lambda found, i: F.coalesce(found, payer_of_charge_line(lines, i, stops)),
            ),
        )

    return let(segment_lines, searched)
