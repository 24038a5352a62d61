"""What several training-data operators share: written tables, running totals and input columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.sources.scratch import written as materialise

#: ASCII white space, the only separators of words in every contract here.
SPACES = "\\x20\\x09-\\x0D"


def running_total(df: DataFrame, order: Sequence[str], value: str, name: str, group: Sequence[str] = ()) -> DataFrame:
    """Adds `name`: the sum of `value` over all rows before this one, within `group`, in `order`.

    Rows are dealt by ranges of `order`, so no group meets in one task: each
    range sums its own rows, and the ranges' totals (one row per range and
    group) give every range its start. `group` columns must not be null.
    """
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    group = list(group)
    totals = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # starts has at most (ranges x groups) rows, whatever the input's size
    return (
        ranged.join(F.broadcast(starts), ["_part", *group])
        .withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_part", "_start")
    )


def bounded(ids: DataFrame, rows: int = 500_000) -> DataFrame:
    """ids (a written table of one or two numbers a row), to be broadcast if it has at most `rows` rows; else joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have, whatever the case of their letters."""
    have = {c.lower() for c in df.columns}
    return [next(n for n in (name + "_" * k for k in range(len(have) + 1)) if n.lower() not in have) for name in names]


def let(value, body):
    """body(x) with x bound to value, which is then evaluated once a row."""
    return F.transform(F.array(value), body)[0]


@contextmanager
def record_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs send at most `rows` rows to Python at once: what long texts need in memory is bounded by few of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_rows(df: DataFrame, column: str, make_test: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of df whose `column` passes a test, in batches and without a shuffle.

    make_test() runs once a task and returns the test of a list of values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make_test()
        for b in batches:
            for k in range(0, b.num_rows, 300):
                part = b.slice(k, 300)
                yield part.filter(pa.array(test(part.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)
