"""A list stored in its display order, so that a page however deep reads the one or two parts that hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswire.plans.catalog import FEED_KEY, client_key


def store_order(df: DataFrame, path: str, field: str, ascending: bool = True, parts: int | None = None) -> None:
    """sort_client, stored: ``df`` by ``field`` (strings in any case, ties by url) in range parts under ``path``.

    ``parts``: how many (the session's shuffle partitions when not given).  Beside the rows lies a directory of one row
    per part: how many rows it has and how many come before it.  The ties' url lets ranges cut through runs
    of equal values; rows equal in both are in one part.
    """
    spark = df.sparkSession
    named = df.select("*", client_key(df, field).alias("_key"))
    order = _order(ascending)
    named.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # an empty list has no other file to tell them
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (named.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .withColumn("_part", F.spark_partition_id()).write.mode("overwrite").partitionBy("_part").parquet(f"{path}/rows"))
    sizes = _rows(spark, path).groupBy("_part").agg(F.count(F.lit(1)).alias("n_rows"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes.withColumn("n_before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/directory")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("_part", "integer")).parquet(f"{path}/rows")


def _order(ascending: bool) -> list[Column]:
    return [F.col("_key").asc() if ascending else F.col("_key").desc(), F.col(FEED_KEY).asc()]


def stored_page(spark: SparkSession, path: str, page: int, size: int, ascending: bool = True) -> DataFrame:
    """page_client from a stored order: page ``page`` (below 1: the first) of ``size`` rows; none beyond the end.

    The directory names the parts that hold the page and the rows before them; the scan is pruned to these parts.
    """
    first = (max(1, page) - 1) * size
    held = (spark.read.parquet(f"{path}/directory")
            .where((F.col("n_before") < first + size) & (F.col("n_before") + F.col("n_rows") > first))
            .orderBy("_part").collect())  # at most ``size`` rows: each part holds a row of the page
    rows = _rows(spark, path)
    skip = first - held[0].n_before if held else 0
    return (rows.where(F.col("_part").isin([r["_part"] for r in held]) if held else F.lit(False))
            .orderBy(*_order(ascending)).offset(skip).limit(size).drop("_part", "_key"))
