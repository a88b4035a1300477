"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet into the
shared folder and reread as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm.common import stored, with_row_key
from presswire.llm.mixing import sainte_lague_mix
from presswire.llm.packing import pack_sequences
from presswire.llm.quality import filter_quality
from presswire.llm.secrets import redact_secrets
from presswire.llm.simhash import keep_one
from presswire.sources.tables import read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group stays: that with the smallest doc_id (null only if no row of the group has one)."""
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are blacked out; every document stays."""
    return redact_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row comes as often as the mix takes its words, rounded: up to twice, or not at all.

    Every row has its own share, also without a doc_id or with one that other rows have.  Repeats
    are rows with the same doc_id.
    """
    rows = with_row_key(docs, "pipeline-mix")
    shares = sainte_lague_mix(rows, row=("_row",)).where("size > 0").select(
        "_row", F.least(F.round(F.col("taken") / F.col("size")), F.lit(2)).cast("int").alias("_times"))
    return (rows.join(shares, "_row").where("_times > 0")
            .withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mixed documents in sequences of at most 2048."""
    return pack_sequences(docs, ids=True)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_dedup), ("secret scans", secrets),
          ("mixing", mix), ("packing", pack)]

#: SQL has no zstandard, conditional random field or tokenizer: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{i}")
    return docs
