"""Reading parquet tables by name, and spreading small inputs over the cores."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; a single file or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores.

    Scans of large tables are left as they are (no shuffle). Only an input of fewer
    splits than cores, such as one small file with a single row group, is
    repartitioned, by the hash of ``key`` so that a lost task is recomputed alike.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores, key)
    return df
