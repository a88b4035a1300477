"""Medallion pipeline: raw CSV -> bronze -> silver -> gold, incremental and rerunnable.

Every layer is a Parquet table partitioned by ``article_date``, so reads of
one day prune to one folder.  Bronze holds each article of a day once: the url
names it, and of several versions the lowest by (heading, body, category, url,
channel) stays, nulls first.  So the same files give the same bronze in any
batches and any order, and a rerun adds nothing; rows with a bad date are kept in
a partition without a date.  Silver and gold rebuild exactly the days that
changed and replace their partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from presswire.operators.enrich import GOLD_COLUMNS, enrich_gold
from presswire.operators.joins import anti_loaded_keys
from presswire.operators.rules import SILVER_COLUMNS, silver_rules
from presswire.sources import files

#: Bytes of a layer's Parquet row groups: a scan gives a task one of them at least.
ROW_GROUP = 4 << 20

BRONZE_COLUMNS = files.RAW_COLUMNS + ["ingested_at"]

DDL = {
    "bronze": ("heading STRING, body STRING, category_from_url STRING, url STRING, channel STRING, "
               "ingested_at TIMESTAMP, article_date DATE", "Raw articles as loaded from the daily CSV"),
    "silver": ("heading STRING, body_original STRING, body_cleaned STRING, category_from_url STRING, "
               "url STRING, channel STRING, cleaned_at TIMESTAMP, article_date DATE",
               "Filtered and cleaned articles"),
    "gold": ("heading STRING, body_cleaned STRING, url STRING, channel STRING, category STRING, "
             "positive_score DOUBLE, negative_score DOUBLE, neutral_score DOUBLE, sentiment_label STRING, "
             "ministry STRING, is_negative_alert BOOLEAN, processed_at TIMESTAMP, article_date DATE",
             "Scored, classified articles with ministry and alert flag"),
}


@dataclass
class Layers:
    """Locations of the three layers under one warehouse root."""

    root: str

    def path(self, layer: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}"

    def read(self, spark: SparkSession, layer: str) -> DataFrame | None:
        p = self.path(layer)
        return spark.read.schema(DDL[layer][0]).parquet(p) if files.path_exists(spark, p) else None

    def create_tables(self, spark: SparkSession, database: str = "news") -> None:
        """ddl_tables: database and the three tables, partitioned by date, if missing."""
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
        for layer, (cols, comment) in DDL.items():
            spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{layer}_articles ({cols}) USING PARQUET "
                      f"PARTITIONED BY (article_date) LOCATION '{self.path(layer)}' COMMENT '{comment}'")


def write_layer(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write by day: only the partitions present in ``df`` are replaced (or, with ``append``, added to).

    The rebalance hint lets the planner split a large day over tasks and gather small ones.  Row groups are small, so
    that the load of a single day can be read by as many tasks as there are cores.
    """
    (df.hint("rebalance", "article_date").write.mode(mode).option("parquet.block.size", ROW_GROUP)
     .option("partitionOverwriteMode", "dynamic").partitionBy("article_date").parquet(path))


def days_of(df: DataFrame | None) -> list:
    """The days of a layer or a batch (one value per day, None for rows without a date)."""
    return [] if df is None else [r[0] for r in df.select("article_date").distinct().collect()]


def on_days(df: DataFrame, days: list) -> DataFrame:
    """The rows of ``days``, as a filter on the partition column that reaches the scan."""
    day, known = F.col("article_date"), [x for x in days if x is not None]
    cond = day.isin(known) if known else F.lit(False)
    return df.where((cond | day.isNull()) if None in days else cond)


def _article() -> Column:
    """What names an article within its day: the url, else a hash of heading and body (a null is no empty text)."""
    said = F.to_json(F.struct("heading", "body"))     # leaves nulls out
    return F.coalesce("url", F.concat(F.lit("content:"), F.sha2(said, 256)))


#: What decides between versions of an article: the lowest stays.
VERSION = ["heading", "body", "category_from_url", "url", "channel"]


def one_per_article(bronze: DataFrame) -> DataFrame:
    """Each article of a day once, its lowest version; copies of a version keep the earliest load stamp.

    Partial minima come first, so an article that a batch holds many times costs one row per task.
    """
    lowest = F.min(F.struct(*VERSION, "ingested_at")).alias("_row")
    return bronze.groupBy("article_date", _article().alias("_article")).agg(lowest).select(
        *[F.col(f"_row.{c}") for c in files.RAW_COLUMNS if c != "article_date"], "article_date", "_row.ingested_at")


def against_bronze(batch: DataFrame, target: DataFrame | None, days: list) -> DataFrame:
    """``batch``, an article of a day once (as ``one_per_article``), with _state: new, lower (than the version held) or held.

    Of the target only ``days`` are read.  They go into the same grouping as the batch, so that its texts are sorted
    and dealt out once, not again for a join.
    """
    if target is None:
        return one_per_article(batch).withColumn("_state", F.lit("new"))
    row = F.struct(*VERSION, "ingested_at")
    none = F.lit(None)
    came = batch.select("article_date", _article().alias("_article"), row.alias("_row"), none.cast(_type(batch, VERSION)).alias("_held"))
    held = on_days(target, days).select("article_date", _article().alias("_article"),
                                        none.cast(_type(batch, [*VERSION, "ingested_at"])).alias("_row"), F.struct(*VERSION).alias("_held"))
    both = came.union(held).groupBy("article_date", "_article").agg(F.min("_row").alias("_row"), F.min("_held").alias("_held"))
    version = F.struct(*[F.col(f"_row.{c}").alias(c) for c in VERSION])
    state = F.when(F.col("_held").isNull(), "new").when(version < F.col("_held"), "lower").otherwise("held")
    return both.where(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.{c}") for c in files.RAW_COLUMNS if c != "article_date"], "article_date", "_row.ingested_at", state.alias("_state"))


def _type(df: DataFrame, columns: list[str]) -> StructType:
    return StructType([df.schema[c] for c in columns])


def new_dates_only(incoming: DataFrame, target: DataFrame | None) -> DataFrame:
    """anti_loaded_date / inc_guard: drop rows whose date the target already holds."""
    return incoming if target is None else anti_loaded_keys(incoming, target, ["article_date"])


def to_bronze(raw: DataFrame) -> DataFrame:
    """load_bronze: date via try_cast (a bad date becomes NULL instead of failing), load stamp."""
    return raw.select(*[c for c in files.RAW_COLUMNS if c != "article_date"],
                      F.col("article_date").try_cast("date").alias("article_date"),
                      F.current_timestamp().alias("ingested_at"))


def add_bronze(spark: SparkSession, layers: Layers, raw: DataFrame) -> dict:
    """Bring bronze to what it would be had the articles of ``raw`` come with all earlier ones in one batch.

    New articles are appended, counted while they are written; rows with a bad date are counted and kept.  Where a
    version lower than the one held comes in, its day is rebuilt from bronze and ``raw``.
    """
    bronze = to_bronze(raw)
    days = days_of(bronze)      # reads one column of the raw files
    flagged = against_bronze(bronze, layers.read(spark, "bronze"), days)
    seen, new = Observation(), F.col("_state") == "new"
    counted = flagged.observe(seen, F.count_if(new).alias("new"), F.count_if(F.col("_state") == "lower").alias("lower"),
                              F.count_if(new & F.col("article_date").isNull()).alias("bad"))
    write_layer(counted.where(new).select(*BRONZE_COLUMNS), layers.path("bronze"), "append")
    lower_rows = flagged.where(F.col("_state") == "lower")
    added, lower, bad = files.counts_of(seen, "new", "lower", "bad") or (0, lower_rows.count(), 0)
    if lower:
        changed = days_of(lower_rows)
        both = on_days(layers.read(spark, "bronze").unionByName(bronze), changed)
        write_layer(one_per_article(both).checkpoint(), layers.path("bronze"))  # stored first: it reads what it replaces
    rows = added + lower
    return {"status": "loaded" if rows else "already ingested", "rows": rows, "bad_dates": bad, "days": days}


def load_bronze(spark: SparkSession, layers: Layers, raw_path: str) -> dict:
    """Load one daily CSV into bronze; articles already in bronze are skipped."""
    if not files.path_exists(spark, raw_path):
        return {"status": "no file", "rows": 0, "bad_dates": 0, "days": []}
    return add_bronze(spark, layers, files.read_raw_csv(spark, raw_path))


#: The load stamp of each layer.
STAMP = {"bronze": "ingested_at", "silver": "cleaned_at", "gold": "processed_at"}


def stale_days(spark: SparkSession, layers: Layers, source: str, target: str, among: list | None = None) -> list:
    """Days that ``target`` lacks, or that got rows in ``source`` after ``target`` was built: by the layers' load stamps.

    ``among``: only these days are looked at.
    """
    def last(layer: str) -> DataFrame:
        rows = layers.read(spark, layer)
        return (rows if among is None else on_days(rows, among)).groupBy("article_date").agg(F.max(STAMP[layer]).alias(f"_{layer}"))

    new = last(source)
    if layers.read(spark, target) is None:
        return [r[0] for r in new.select("article_date").collect()]
    built = last(target).withColumnRenamed("article_date", "_day")
    late = new.join(built, F.col("article_date").eqNullSafe(F.col("_day")), "left").where(
        F.col(f"_{target}").isNull() | (F.col(f"_{source}") >= F.col(f"_{target}")))
    return [r[0] for r in late.select("article_date").collect()]


def _load_layer(spark: SparkSession, layers: Layers, source: str, target: str, days: list | None, rebuild: bool, build) -> dict:
    src = layers.read(spark, source)
    if src is None:
        return {"status": f"no {source}", "rows": 0}
    if rebuild and days is None:
        days = days_of(src)
    elif not rebuild:
        days = stale_days(spark, layers, source, target, days)
    n = 0
    if days:
        seen = Observation()
        write_layer(build(on_days(src, days)).observe(seen, F.count(F.lit(1)).alias("rows")), layers.path(target))
        n = (files.counts_of(seen, "rows") or [0])[0]
    return {"status": "loaded" if n else "nothing new", "rows": n}


def load_silver(spark: SparkSession, layers: Layers, days: list | None = None, rebuild: bool = False) -> dict:
    """Silver rules for the days that silver lacks or that bronze got rows of since.

    ``days``: only these are looked at; with ``rebuild`` they are done in any case.
    """
    return _load_layer(spark, layers, "bronze", "silver", days, rebuild, lambda b: silver_rules(b).select(*SILVER_COLUMNS)
                       .withColumn("cleaned_at", F.current_timestamp()))


def load_gold(spark: SparkSession, layers: Layers, days: list | None = None, rebuild: bool = False) -> dict:
    """Gold enrichment for the days that gold lacks or that silver rebuilt since; ``days`` and ``rebuild`` as for silver."""
    return _load_layer(spark, layers, "silver", "gold", days, rebuild,
                       lambda s: enrich_gold(s).select(*GOLD_COLUMNS, "processed_at"))


def append_batch(df: DataFrame, path: str, batch_id: str) -> None:
    """append_silver / append_gold: add ``df`` to a table by day as the batch of that name.

    The batch is a partition below the day.  A rerun replaces the partitions it writes, so it adds nothing; other
    batches of the same days stay.
    """
    (df.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", "article_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("article_date", "batch_id").parquet(path))


def catalog_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The Parquet table at ``path`` through the catalog, with the partitions it has now."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING PARQUET LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return spark.table(name)


def scan_by_date(layer: DataFrame, runs: DataFrame) -> DataFrame:
    """scan_by_date: the rows of the days that ``runs`` (run_date, status) has as due.

    The days come from a table, so they are known only at run time: the planner prunes the layer's partitions by
    them (dynamic partition pruning) before its files are read.
    """
    due = runs.where(F.col("status") == "due").select(F.col("run_date").alias("article_date"))
    return layer.join(due, "article_date", "left_semi")


def run_day(spark: SparkSession, layers: Layers, raw_root: str, run_date: str) -> dict:
    """The daily job: raw file of ``run_date`` -> bronze -> the days it touched in silver and gold."""
    bronze = load_bronze(spark, layers, files.daily_path(raw_root, run_date))
    return {"bronze": bronze, "silver": load_silver(spark, layers, bronze["days"]),
            "gold": load_gold(spark, layers, bronze["days"])}
