"""What kind of page a text looks like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallyspark import fixed
from tallyspark.functions.text import strip


def _mentions(text: Column, signals: list) -> Column:
    def one(signal) -> Column:
        phrases = signal if isinstance(signal, list) else [signal]
        return reduce(lambda a, b: a & b, [text.contains(p) for p in phrases])

    return reduce(lambda a, b: a | b, [one(s) for s in signals])


def page_kind(text: Column) -> Column:
    lowered = F.lower(text)
    kind = F.when(F.coalesce(strip(text), F.lit("")) == "", "empty")
    for name, signals in fixed.PAGE_KIND_RULES:
        kind = kind.when(_mentions(lowered, signals), name)
    return kind.otherwise("other")


def page_use(kind: Column) -> Column:
    """``billing`` pages are extracted from, ``noise`` pages are skipped, the rest is undecided."""
    return (
        F.when(kind.isin(fixed.BILLING_KINDS), "billing")
        .when(kind.isin(fixed.NOISE_KINDS), "noise")
        .otherwise("undecided")
    )


def image_area_ratio(images: Column, page_width: Column, page_height: Column) -> Column:
    """Share of a page covered by its images; images are ``struct<x0,x1,top,bottom>``."""
    covered = F.aggregate(
        images,
        F.lit(0.0),
        lambda total, i: total + F.abs(i["x1"] - i["x0"]) * F.abs(i["bottom"] - i["top"]),
    )
    area = page_width * page_height
    return F.when(area > 0, F.coalesce(covered, F.lit(0.0)) / area).otherwise(F.lit(0.0))
