"""Shared helpers of the training-data operators: tables, stored stages, numbering, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from presswire.session import checkpoint_dir
from presswire.sources.tables import read_table

#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def tune(spark: SparkSession) -> None:
    """Small Arrow batches (texts can be long) and shuffle files that go when their query has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared checkpoint folder and reread it.

    The files survive lost executors; a failed write leaves nothing behind that is read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_key(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with a column _row (file, place in it), another one for every row and the same whenever it is read.

    What isn't a plain scan of Parquet files is stored first.
    """
    plan = df._jdf.queryExecution().analyzed()
    scan = plan.getClass().getSimpleName() == "LogicalRelation" and "ParquetFileFormat" in (
        plan.relation().fileFormat().getClass().getName() if "HadoopFs" in plan.relation().getClass().getName() else "")
    return (df if scan else stored(df, tag)).select("*", F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias("_row"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def numbered(df: DataFrame, keys: list[str], out: str, tag: str) -> tuple[DataFrame, int]:
    """Gapless global row numbers 0..n-1 in the order of ``keys`` and the number of rows.

    Rows are dealt by ranges of the keys, sorted inside each partition, stored, and shifted by
    the rows of the partitions before.  Only one small row per partition is gathered, no task
    holds more than its range, and a retried task rereads the stored numbers.
    """
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = (df.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
             .withColumn("_mid", F.monotonically_increasing_id()))
    local = (stored(local, tag)
             .withColumn("_part", F.shiftright("_mid", 33))
             .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = sorted((r["_part"], r["n"]) for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    base = df.sparkSession.createDataFrame(list(starts.items()), T.StructType([
        T.StructField("_part", T.LongType()), T.StructField("_base", T.LongType())]))
    # one row per range partition: the size is the partition count, not the data
    got = (local.join(F.broadcast(base), "_part")
           .withColumn(out, F.col("_base") + F.col("_pos")).drop("_part", "_pos", "_mid", "_base"))
    return got, total


def components(edges: DataFrame, tag: str) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternating large-star and small-star rounds; every round is a join with per-node minima
    (pre-aggregated, so a hub costs one row per task) and is stored, so that a lost executor
    repeats one round.  Loops until the edge set no longer changes.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, tag)

    def mark(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = mark(e)
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = (both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
             .where("a <> b").distinct())
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = (e.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").where("a <> b").distinct())
        e = stored(e, tag)
        now = mark(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def star_edges(a, b):
    """Join links (arrays a, b of node ids) into as few edges as a spanning star forest: (node, root) arrays.

    The links of one task may be many for few nodes; sending a star on keeps the rows linear.
    """
    import numpy as np

    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[:len(a)], inv[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        nxt = root.copy()
        np.minimum.at(nxt, root[x], low)
        np.minimum.at(nxt, root[y], low)
        nxt = nxt[nxt]
        while True:
            jump = nxt[nxt]
            if (jump == nxt).all():
                break
            nxt = jump
        if (nxt == root).all():
            break
        root = nxt
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]
