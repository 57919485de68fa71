"""Dates printed inside free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.functions.text import let


def _token_to_date(token: Column) -> Column:
    def parsed(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i)).cast("int")
        iso = F.length(F.get(parts, F.lit(0))) == 4
        short = (
            F.when(part(2) < fixed.CENTURY_PIVOT, part(2) + 2000)
            .when(part(2) < 100, part(2) + 1900)
            .otherwise(part(2))
        )
        year = F.when(iso, part(0)).otherwise(short)
        month = F.when(iso, part(1)).otherwise(part(0))
        day = F.when(iso, part(2)).otherwise(part(1))
        text = F.format_string("%04d-%02d-%02d", year, month, day)
        return F.when(year >= 100, F.try_to_date(text, "yyyy-MM-dd"))

    return let(F.split(token, "[/-]"), parsed)


def dates_in(text: Column) -> Column:
    """Every valid calendar date, in text order; impossible dates are left out."""
    tokens = F.regexp_extract_all(text, F.lit(fixed.DATE_TOKEN), F.lit(0))
    return F.array_compact(F.transform(tokens, _token_to_date))


def treatment_span(text: Column) -> Column:
    """First and last date in text order, as ``struct<start_date, end_date>``."""
    return let(
        dates_in(text),
        lambda found: F.struct(
            F.try_element_at(found, F.lit(1)).alias("start_date"),
            F.try_element_at(found, F.lit(-1)).alias("end_date"),
        ),
    )


def printed_range(dates: Column) -> Column:
    """``earliest - latest`` of printed ``MM/DD/YYYY`` dates; null when one of them is no calendar date."""
    parsed = F.transform(dates, lambda d: F.try_to_date(d, "MM/dd/yyyy"))
    show = lambda d: F.date_format(d, "MM/dd/yyyy")
    return let(
        parsed,
        lambda found: F.when(
            ~F.exists(found, lambda d: d.isNull()),
            F.concat(show(F.array_min(found)), F.lit(" - "), show(F.array_max(found))),
        ),
    )
