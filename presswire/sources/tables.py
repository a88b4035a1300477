"""Readers for the input tables (one Parquet data set per table name)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan; later projections and filters are pushed into it."""
    return spark.read.parquet(table_path(sf_dir, name))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give CPU-heavy per-row work (text cleaning, HTML parsing) one task per core.

    A scan plans its tasks from the file layout, so a small table stored as
    one Parquet row group is read, and then cleaned and scored, by one task.
    When the scan plans fewer partitions than the cluster has cores, the rows
    are hash-partitioned by ``key`` (a unique row id: even spread,
    deterministic on retry).  At scale a scan already has far more
    partitions than cores and this adds nothing: no shuffle of the raw text.
    ``presswire.spread`` = auto (default) | always | never.
    """
    spark = df.sparkSession
    mode = spark.conf.get("presswire.spread", "auto")
    if mode == "never":
        return df
    cores = spark.sparkContext.defaultParallelism
    if mode == "auto" and df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)
