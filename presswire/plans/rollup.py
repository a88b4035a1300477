"""Incrementally kept daily rollup of the gold layer, and the dashboard queries that read only it.

One row per day and combination of the dashboard's keys, holding states that add up: counts, alerts and
exact decimal sums.  Means are sums over counts, distinct channels and categories are the distinct keys, so
every panel over any days equals the scan of gold.  ``refresh_rollup`` rebuilds only the days whose gold rows
changed since, by the load stamps, and of gold reads only those days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.functions import scores as S
from presswire.operators.rules import nonblank
from presswire.plans import catalog as Q
from presswire.plans import pipeline as P
from presswire.sources import files

KEYS = Q.PANEL_KEYS
SUMS = {"sum_pos": "positive_score", "sum_neg": "negative_score", "sum_neu": "neutral_score"}
SCHEMA = ("channel STRING, category STRING, ministry STRING, sentiment_label STRING, cnt BIGINT, alerts BIGINT, "
          + ", ".join(f"{s} DECIMAL(28,4), n_{s} BIGINT" for s in SUMS) + ", rolled_at TIMESTAMP, article_date DATE")


def rollup_rows(gold: DataFrame) -> DataFrame:
    """The states of ``gold`` by day and key combination (null keys are keys of their own)."""
    sums = [x for s, c in SUMS.items()
            for x in (F.sum(F.col(c).cast("decimal(18,4)")).alias(s), F.count(c).alias(f"n_{s}"))]
    return gold.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cnt"), F.count_if("is_negative_alert").alias("alerts"), *sums)


def read_rollup(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.schema(SCHEMA).parquet(path) if files.path_exists(spark, path) else None


def refresh_rollup(spark: SparkSession, layers: P.Layers, path: str, days: list | None = None) -> list:
    """Rebuild the days of the rollup at ``path`` that gold changed since; returns them.

    ``days``: only these are looked at.  A rerun rebuilds nothing new and changes no number.
    """
    gold = layers.read(spark, "gold")
    if gold is None:
        return []
    new = (gold if days is None else P.on_days(gold, days)).groupBy("article_date").agg(F.max("processed_at").alias("_gold"))
    held = read_rollup(spark, path)
    if held is not None:
        built = held.groupBy(F.col("article_date").alias("_day")).agg(F.max("rolled_at").alias("_rolled"))
        new = new.join(built, F.col("article_date").eqNullSafe(F.col("_day")), "left").where(
            F.col("_rolled").isNull() | (F.col("_gold") >= F.col("_rolled")))
    stale = [r[0] for r in new.select("article_date").collect()]  # one value per day
    if stale:
        P.write_layer(rollup_rows(P.on_days(gold, stale)).withColumn("rolled_at", F.current_timestamp()), path)
    return stale


def _mean(name: str):
    return S.round_half_up(F.sum(name).cast("double") / F.sum(f"n_{name}").cast("double"), 4)


def trends(rollup: DataFrame, channel=None, category=None) -> DataFrame:
    """agg_trends from the rollup."""
    return (Q.flt_conj_eq(rollup, channel=channel, category=category).groupBy("article_date")
            .agg(_mean("sum_pos").alias("avg_positive"), _mean("sum_neg").alias("avg_negative"),
                 _mean("sum_neu").alias("avg_neutral"), F.sum("cnt").alias("article_count")).orderBy("article_date"))


def history(rollup: DataFrame) -> DataFrame:
    """agg_history from the rollup."""
    return (rollup.groupBy("article_date").agg(F.sum("cnt").alias("total_articles"), F.sum("alerts").alias("negative_alerts"))
            .orderBy(F.desc("article_date")))


def totals(rollup: DataFrame, date=None) -> DataFrame:
    """Articles, alerts and the exact numbers of channels and categories, of one day or of all."""
    category = F.when(nonblank(F.col("category")), F.col("category"))
    return Q.flt_date(rollup, date).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("articles"), F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"),
        F.count_distinct("channel").alias("channels"), F.count_distinct(category).alias("categories"))


def panels(rollup: DataFrame, date=None) -> DataFrame:
    """agg_panels from the rollup; a date prunes it to one partition."""
    states = Q.flt_date(rollup, date).select(*KEYS, "cnt", *SUMS)
    return Q.panel_sets(states, F.sum("cnt"), F.sum("sum_pos"), F.sum("sum_neg"), F.sum("sum_neu"),
                        F.sum(F.col("sum_pos") - F.col("sum_neg")))
