"""The transcript tables: plain Parquet tables with a column `commit`, and one table of commits.

A commit appends its rows to each table under a number of its own, and then one row a
table to `commits`; rows of a number that isn't there are never read, so readers see
all of a commit or nothing. Rows of a key that a later commit gives again are
superseded by it. Spark does the reading, pruning by the partition column, and the
writing. Commits are made by one driver at a time.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.operators.insights import relabel
from loomline.schema import TABLES, conform, struct
from loomline.sources.scratch import written

TERMINAL = ("done", "failed")
#: Tables whose rows are known by a key; of each key the last commit's row counts.
KEYS = {"sessions": ["project_dir", "session_id"], "jobs": ["id"]}
COMMITS = "commit bigint, tab string, whole boolean"


class Store:
    """The tables in a folder; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _rows(self, folder: str, schema) -> DataFrame:  # noqa: ANN001
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _shown(self, table: str) -> list[int]:
        """The commits that make up a table: from the last one that replaced it on. One number a commit."""
        rows = self._rows("commits", COMMITS).filter(F.col("tab") == table).orderBy("commit").collect()
        whole = max((k for k, r in enumerate(rows) if r["whole"]), default=0)
        return [r["commit"] for r in rows[whole:]]

    def has(self, table: str) -> bool:
        """Whether any commit has written it."""
        return bool(self._shown(table))

    def read(self, table: str) -> DataFrame:
        """A table as of the last commit; missing columns hold their defaults."""
        shown = self._shown(table)
        if not shown:
            return self.spark.createDataFrame([], struct(table))
        rows = self._rows(table, struct(table).add("commit", "long")).filter(F.col("commit").isin(shown))
        if table in KEYS:
            last = F.max_by(F.struct(*[c for c in rows.columns if c not in KEYS[table]]), "commit").alias("last")
            rows = rows.groupBy(*KEYS[table]).agg(last).select(*KEYS[table], "last.*")
        return conform(rows, table)

    def tables(self) -> dict[str, DataFrame]:
        """All tables; the index of texts only if there is one, as an empty one would name nothing."""
        return {t: self.read(t) for t in TABLES if t != "insight_grams" or self.has(t)}

    def commit(self, changed: Mapping[str, DataFrame], added: Mapping[str, DataFrame] | None = None) -> None:
        """Tables of `changed` become what is given; rows of `added` come to what their tables hold, in the place of rows of their key."""
        number, rows = time.time_ns(), []
        for whole, given in ((True, changed), (False, added or {})):
            for table, df in given.items():
                conform(df, table).withColumn("commit", F.lit(number)).write.mode("append").partitionBy("commit").parquet(f"{self.root}/{table}")
                rows.append((number, table, whole))
        # one file: it appears with its rename, and the commit with it
        self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def compact(self, table: str) -> None:
        """Writes a table anew as the rows of one commit."""
        self.commit({table: self.read(table)})

    def next_ids(self, table: str, rows: DataFrame, *order: str) -> DataFrame:
        """rows with ids that go on after the table's greatest, in an order."""
        last = self.read(table).agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
        return with_ids(rows, last, *order)

    def append_derived(self, rows: DataFrame) -> None:
        """K4: derived insights are added, never replaced."""
        self.commit({}, {"derived_insights": self.next_ids("derived_insights", rows, "created_at", "text")})

    def relabel_run(self, project_dir: str, session_id: str, old: str, new: str) -> int:
        """K5: renames a run; how many episodes changed."""
        marked = relabel(self.read("episodes"), project_dir, session_id, old, new)
        changed = marked.filter("relabeled").count()
        if changed:
            self.commit({"episodes": marked})
        return changed

    def put_job(self, job: Mapping[str, str | None]) -> None:
        """K6: creates a job or replaces its row; result and error are null unless given."""
        row = {k: job.get(k) for k in struct("jobs").names}
        self.commit({}, {"jobs": self.spark.createDataFrame([tuple(row.values())], struct("jobs"))})

    def job(self, job_id: str) -> dict | None:
        found = self.read("jobs").filter(F.col("id") == job_id).first()
        return found.asDict() if found else None

    def evict_jobs(self, before: str) -> int:
        """K7: drops finished jobs not updated since an instant; a running one stays."""
        gone = F.coalesce(F.col("status").isin(*TERMINAL) & (F.col("updated_at") < before), F.lit(False))
        jobs = self.read("jobs")
        n = jobs.filter(gone).count()
        if n:
            self.commit({"jobs": jobs.filter(~gone)})
        return n


def with_ids(rows: DataFrame, last: int, *order: str) -> DataFrame:
    """Consecutive ids from last + 1 on.

    Rows are dealt by ranges of the order; each range numbers its own and starts
    after the rows of the ranges before it, so that no task numbers all rows.
    """
    ranged = written(rows.drop("id").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "_part").withColumn("id", F.lit(last) + F.col("_start") + inside).drop("_part", "_start")


def pack_vector(column: str) -> Column:
    """Vectors are kept as 32-bit floats."""
    return F.transform(column, lambda x: x.cast("float"))
