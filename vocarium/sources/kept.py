"""Intermediate tables, written to the folder that the cluster shares and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder. Only a local master may do without:
    on a cluster, a folder of one machine would lose what executors write."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        folder = context._jsc.sc().getCheckpointDir()
        if folder.isDefined():
            return folder.get()
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vocarium-")
        context.setCheckpointDir(base)
    return base


def kept(df: DataFrame) -> DataFrame:
    """The table by itself: what made it is no longer in the plan, which stays short however often it is used."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
