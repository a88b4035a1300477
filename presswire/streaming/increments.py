"""Incremental loads with Structured Streaming.

* ``stream_bronze`` – inc_bronze: a file source over the raw-CSV folder picks
  up each new file exactly once (the checkpoint records what was read); every
  micro-batch brings bronze to what one batch of all files would give (several
  files of a day add up, a replayed batch adds nothing) and rebuilds its days
  in silver and gold.
* ``stream_daily`` – inc_daily_window: running daily counts and mean values
  over ``events``.  A batch adds its own partial states to the partitions of the
  days it touched; the states add up, so late rows of any age count and nothing
  is held in memory for closed days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.plans.pipeline import Layers, add_bronze, load_gold, load_silver
from presswire.sources import files


def stream_bronze(spark: SparkSession, layers: Layers, raw_dir: str, checkpoint: str,
                  cascade: bool = True, files_per_batch: int | None = None) -> dict:
    """Run the raw-folder stream until every available file is processed.

    Bronze itself is the state that tells new articles from known ones, so the files may come in any
    batches (``files_per_batch`` at most in one) and give the same bronze.
    """

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        done = add_bronze(spark, layers, batch)
        if cascade:  # all days of the batch, so that a replayed batch completes them
            load_silver(spark, layers, done["days"])
            load_gold(spark, layers, done["days"])

    reader = spark.readStream.schema(files.RAW_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    src = (reader.option("header", True).option("multiLine", True)
           .option("quote", '"').option("escape", '"').option("pathGlobFilter", "*.csv")
           .option("recursiveFileLookup", True).csv(raw_dir))
    q = (src.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return {"batches": len(q.recentProgress)}


STATE = "event_type STRING, events BIGINT, n_values BIGINT, sum_value DOUBLE, batch_id STRING, day DATE"


def daily_states(events: DataFrame) -> DataFrame:
    """Per event day and type: rows, values and their sum (states that add up)."""
    return (events.groupBy(F.col("ts").cast("timestamp").cast("date").alias("day"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.count("value").alias("n_values"), F.sum("value").alias("sum_value")))


def upsert_daily(events: DataFrame, sink_dir: str, batch: str) -> None:
    """Add the states of one batch to the sink, in a partition per day and batch.

    The batch replaces its own partitions, so a replay after a lost driver adds nothing; other batches and days
    are not read.
    """
    (daily_states(events).withColumn("batch_id", F.lit(batch)).hint("rebalance", "day").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(sink_dir))


def daily_window(spark: SparkSession, sink_dir: str) -> DataFrame:
    """inc_daily_window: per event day and type, count and mean value, from the states in the sink."""
    rows = spark.read.schema(STATE).parquet(sink_dir)
    return rows.groupBy("day", "event_type").agg(
        F.sum("events").alias("events"),
        (F.sum("sum_value") / F.when(F.sum("n_values") > 0, F.sum("n_values"))).alias("mean_value"))


def compact_daily(spark: SparkSession, sink_dir: str, target_dir: str) -> None:
    """Write the sink's states anew with one batch per day (``compact``), for a sink of many batches."""
    rows = spark.read.schema(STATE).parquet(sink_dir)
    merged = rows.groupBy("day", "event_type").agg(*[F.sum(c).alias(c) for c in ("events", "n_values", "sum_value")])
    (merged.withColumn("batch_id", F.lit("compact")).hint("rebalance", "day").write.mode("overwrite")
     .partitionBy("day", "batch_id").parquet(target_dir))


def stream_daily(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str, glob: str = "*.parquet",
                 files_per_batch: int | None = None, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Stream the new event files of ``source_dir`` matching ``glob`` into the daily states and return the days.

    The query itself keeps no state: a row later than any watermark still reaches its day.  ``prepare`` is applied to
    every batch.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(source_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        upsert_daily(prepare(batch), sink_dir, f"b{epoch_id}")

    q = (reader.parquet(source_dir).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return daily_window(spark, sink_dir)
