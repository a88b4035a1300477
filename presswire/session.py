"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Defaults for local runs; on a cluster the submitter's settings win because
# ``getOrCreate`` keeps any value that is already configured.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # text rows can be large (whole articles / pages): keep Arrow batches for
    # the keyword automaton and the HTML parser small enough for worker memory
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "presswire", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the engine's defaults."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the submitter sets ``spark.checkpoint.dir`` to a shared
    folder (HDFS / object store) and it is used as is.  Only when it is unset
    (local tests) is a fresh scratch folder created and registered.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store); "
                           "a machine-local folder does not survive lost executors")
    local = tempfile.mkdtemp(prefix="presswire-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared checkpoint folder and reread it, for work that is read several times."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/scratch/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for Python workers that get whole pages; a lower limit stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))
