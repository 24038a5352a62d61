"""Tables written between the steps of a query, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in a local session without one (tests) a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomline-checkpoints-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read back: computed once, and not lost with an executor."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
