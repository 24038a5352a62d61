"""Numbers along an order that no task sorts whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import written


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`, each row's place (from 0) in its group in an order.

    Rows are dealt by ranges of group and order, each range numbers its own, and one row
    a range and group tells how many came before; groups of any size are so cut up.
    """
    ranged = written(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_range").count()
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    same = [F.col("r." + c).eqNullSafe(F.col("s." + c)) for c in group]
    inside = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order)) - 1
    met = ranged.withColumn("_inside", inside).alias("r").join(starts.alias("s"), [F.col("r._range") == F.col("s._range"), *same])
    return met.select(*[F.col("r." + c) for c in df.columns], (F.col("s._start") + F.col("r._inside")).alias(name))
