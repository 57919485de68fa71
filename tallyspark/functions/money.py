"""Money text to exact cents, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.functions.text import all_matches, first_text
from tallyspark.schema import MONEY_COLUMNS, MONEY_TYPE


def to_cents(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast(MONEY_TYPE)


def amounts_in(text: Column) -> Column:
    """Every printed amount, in order."""
    return F.transform(all_matches(text, fixed.MONEY, 1), to_cents)


def amount_after(text: Column, pattern: str, flags: str = "i") -> Column:
    """First amount captured by ``pattern``, or null."""
    return to_cents(first_text(text, pattern, 1, flags))


def labelled_amount(text: Column, label: str) -> Column:
    return amount_after(text, rf"{label}\s*{fixed.MONEY}")


def guarded_number(text: Column) -> Column:
    """The number when the text is a plain decimal numeral, else null (``N/A``, ``NaN``, ``1e3``)."""
    return F.when(text.rlike(fixed.NUMERIC_TEXT), F.trim(F.regexp_replace(text, r"\s", "")).try_cast("decimal(38,6)"))


def has_money(value: Column) -> Column:
    return value.isNotNull() & (value != 0)


def usd(value: Column) -> Column:
    """``$1,850.00``, ``-$5.00``, and a dash for a missing value."""
    rounded = F.round(value.cast("decimal(38,10)"), 2)
    digits = F.format_number(F.abs(rounded), 2)
    sign = F.when(value < 0, "-").otherwise("")
    return F.coalesce(F.concat(sign, F.lit("$"), digits), F.lit("—"))


def total_or_zero(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("decimal(28,2)")).alias(column)


def totals_or_zero() -> list[Column]:
    return [total_or_zero(name) for name in MONEY_COLUMNS]


def totals_or_null() -> list[Column]:
    return [F.sum(name).alias(name) for name in MONEY_COLUMNS]
