"""What the operators share: table access, texts as bytes, exact keys."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(frame: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``frame`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in frame.columns}
    return next(n for k in count() if (n := f"{name}{k}") not in taken)


def utf8(text: Column) -> Column:
    """A text column as UTF-8 bytes, null as empty: tasks then need not decode what they only hash."""
    return F.coalesce(text.cast("binary"), F.lit(b""))


def hex64(value: Column) -> Column:
    """A long's 64 bits as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def slices(batches, rows: int = 512):
    """Arrow batches in small parts, so that the Python objects of a whole batch do not live at once."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)
