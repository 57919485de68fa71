"""Invoice numbers as shown and as filtered on."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.functions.text import blank_to_null, strip


def normal_invoice(value: Column) -> Column:
    return blank_to_null(strip(value))


def invoice_filter_value(invoice: Column) -> Column:
    return F.coalesce(invoice, F.lit(fixed.MISSING_INVOICE_VALUE))


def invoice_option_label(value: Column) -> Column:
    return F.when(value == fixed.MISSING_INVOICE_VALUE, fixed.MISSING_INVOICE_LABEL).otherwise(value)


def invoice_heading(invoice: Column) -> Column:
    return F.coalesce(F.concat(F.lit("Invoice "), invoice), F.lit(fixed.MISSING_INVOICE_LABEL))
