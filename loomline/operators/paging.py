"""Pages far down an order, without sorting what lies before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import written

#: Rows before a page from which on they are counted by ranges; up to that, Spark keeps the first rows of each task.
DEEP = 50_000
RANGES = 256


def _ranged(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows dealt by ranges of the order, none of them sorted, as a written table with `_range`."""
    return written(rows.repartitionByRange(RANGES, *order).withColumn("_range", F.spark_partition_id()))


def _of_page(ranged: DataFrame, offset: int, limit: int) -> tuple[DataFrame, int]:
    """The rows of the ranges that a page lies in, and how many rows lie before them. The counts are one row a range."""
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_range").count().withColumn("before", before)
    held = counts.filter((F.col("before") < offset + limit) & (F.col("before") + F.col("count") > offset)).collect()
    return ranged.filter(F.col("_range").isin([r["_range"] for r in held])), min((r["before"] for r in held), default=0)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows offset to offset + limit - 1 in an order that leaves no ties.

    For a deep page Spark samples the order into ranges, rows are counted by range, and
    the ranges that hold the page, about one in RANGES, are all that is sorted.
    """
    if offset < DEEP:
        return rows.orderBy(*order).offset(offset).limit(limit)
    held, before = _of_page(_ranged(rows, order), offset, limit)
    return held.drop("_range").orderBy(*order).offset(offset - before).limit(limit)
