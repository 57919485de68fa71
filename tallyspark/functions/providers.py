"""Name of the billing provider of a document."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.functions.text import is_upper, let, rx, strip, title_case


def clean_provider(name: Column) -> Column:
    bare = F.regexp_replace(strip(name), rx(fixed.CUSTODIAN_SUFFIX), "")
    titled = lambda v: F.replace(title_case(v), F.lit(", Pc"), F.lit(", PC"))
    return let(bare, lambda v: F.when(is_upper(v), titled(v)).otherwise(v))
