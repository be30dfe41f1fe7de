"""The folder that the driver and all executors share, and frames written there once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder under `spark.checkpoint.dir`; only without that setting and under a local master in a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(sc, "_newsloom_scratch", None)
        if not base:
            base = sc._newsloom_scratch = "file://" + tempfile.mkdtemp(prefix="newsloom-")
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Written as Parquet and read back: what is costly to make is made once, and lost executors take nothing with them."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """For costly work a row: dealt out to all cores where the scan alone would use fewer (a file of one row group)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
