"""Versions of a table that survive a restart and a batch that is run twice."""

from pyspark.sql import functions as F

from tallyspark.streaming.versions import VersionedTable


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def content(frame):
    return sorted(r.n for r in frame.collect())


def test_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "table"))
    assert table.versions() is None and table.read() is None and table.read(before=3) is None
    table.write(numbers(spark, 1, 2), 0)
    table.write(table.read(before=1).select((F.col("n") * 10).alias("n")), 1)
    assert content(table.read()) == [10, 20] and content(table.read(before=1)) == [1, 2]
    assert table.read(before=0) is None
    # the last batch again, by a driver that knows nothing of the first run
    again = VersionedTable(spark, str(tmp_path / "table"))
    again.write(again.read(before=1).select((F.col("n") * 10).alias("n")), 1)
    assert content(again.read()) == [10, 20]
    assert sorted(r.batch for r in again.versions().collect()) == [0, 1]


def test_a_version_that_broke_off_is_not_read(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "table"))
    table.write(numbers(spark, 5), 7)
    numbers(spark, 6).write.parquet(str(tmp_path / "table" / "version-8"))
    assert content(table.read()) == [5] and content(table.read(before=9)) == [5]
    table.write(numbers(spark, 8), 8)
    assert content(table.read()) == [8]
