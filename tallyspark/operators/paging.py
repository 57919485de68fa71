"""The row that stands at a place of an order, found without a top-k of all rows before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyspark.session import stored


class Places:
    """The sort keys of ``rows`` in ranges: ``order`` maps key columns to whether they descend.

    The keys alone are dealt into ranges and stored; the driver holds one count per range. Equal keys share a range.
    """

    def __init__(self, rows: DataFrame, order: dict[str, bool]):
        self.names, self.types = list(order), [rows.schema[name].dataType for name in order]
        self.descends = any(order.values())
        if self.descends and not all(order.values()):
            raise ValueError("keys must all ascend or all descend")
        self.sort = [F.desc(name) if self.descends else F.asc(name) for name in order]
        ranges = rows.select(*order).repartitionByRange(*self.sort)
        self.keys = stored(ranges.withColumn("_range", F.spark_partition_id()), "places")
        self.sizes = sorted((r["_range"], r["count"]) for r in self.keys.groupBy("_range").count().collect())
        self.total = sum(n for _, n in self.sizes)

    def from_place(self, rows: DataFrame, offset: int, limit: int | None) -> DataFrame:
        """At most ``limit`` of ``rows`` in order, without the first ``offset``; nothing past the end.

        Only rows at or after the key at that place are sorted. Rows with that same key that stand before the
        place are skipped.
        """
        start = 0
        for number, size in self.sizes:
            if start + size > offset:
                break
            start += size
        else:
            return rows.limit(0)
        within = Window.partitionBy("_range").orderBy(*self.sort)
        found = (
            self.keys.where(F.col("_range") == number)
            .withColumns({"_row": F.row_number().over(within), "_rank": F.rank().over(within)})
            .where(F.col("_row") == offset - start + 1)
            # as text, so that times do not depend on the driver's zone
            .select(*[F.col(name).cast("string") for name in self.names], (F.col("_row") - F.col("_rank")).alias("_skip"))
            .first()
        )
        bound = F.struct(*[F.lit(found[i]).cast(t).alias(n) for i, (n, t) in enumerate(zip(self.names, self.types))])
        key = F.struct(*self.names)
        ahead = rows.where(key <= bound if self.descends else key >= bound).orderBy(*self.sort)
        if found["_skip"]:
            ahead = ahead.offset(found["_skip"])
        return ahead if limit is None else ahead.limit(limit)
