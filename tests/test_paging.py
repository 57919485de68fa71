"""Rows from a place on, against a sorted list."""

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.paging import Places


def found(rows, order, offset, limit):
    return [tuple(r) for r in Places(rows, order).from_place(rows, offset, limit).collect()]


@pytest.mark.parametrize("descends", [False, True])
def test_places_of_ties_and_nulls(spark, descends):
    table = [(None if i % 7 == 0 else i % 5, f"n{i % 3}") for i in range(60)]
    rows = spark.createDataFrame(table, "k int, name string").repartition(5)
    sort = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=descends)
    order = dict.fromkeys(["k", "name"], descends)
    for offset, limit in [(0, 5), (7, 20), (33, 4), (58, 10), (59, None), (60, 5), (500, None)]:
        stop = None if limit is None else offset + limit
        assert found(rows, order, offset, limit) == sort[offset:stop]


def test_places_of_times_and_of_no_rows(spark):
    rows = spark.range(30).select((F.lit("2024-10-27 00:30:00.000001").cast("timestamp") + F.make_interval(
        hours=F.col("id").cast("int"))).alias("at"), "id")
    assert [r[1] for r in found(rows, {"at": True, "id": True}, 25, 3)] == [4, 3, 2]
    assert found(rows.where("false"), {"at": False}, 0, 5) == []


def test_mixed_directions_are_refused(spark):
    with pytest.raises(ValueError):
        Places(spark.range(3).withColumn("other", F.col("id")), {"id": True, "other": False})
