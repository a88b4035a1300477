"""Daily rollup against scans of gold, stored orders against OFFSET, sheets of one table against a union."""

import re
import tempfile

import pytest
from pyspark.sql import functions as F

from presswire.functions import text as T
from presswire.plans import catalog as Q
from presswire.plans import fixtures as FX
from presswire.plans import pipeline as P
from presswire.plans import report as R
from presswire.plans import rollup as RU
from presswire.plans import stored_order as SO

DAY = "2024-01-15"


def folder(name):
    return tempfile.mkdtemp(prefix=f"pw-{name}-", dir="/tmp") + "/x"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(rollup, gold):
    assert rows(RU.trends(rollup)) == rows(Q.agg_trends(gold))
    assert rows(RU.trends(rollup, channel="click")) == rows(Q.agg_trends(gold, channel="click"))
    assert rows(RU.history(rollup)) == rows(Q.agg_history(gold))
    for day in (None, DAY):
        assert rows(RU.panels(rollup, day)) == rows(Q.agg_panels(gold, day))
    t = RU.totals(rollup).first()
    assert (t.articles, t.channels) == (gold.count(), Q.agg_distinct_channels(gold).first()[0])
    assert t.categories == Q.agg_distinct_categories(gold).first()[0]


def test_rollup_rebuilds_only_touched_days_and_equals_the_scan(spark, sf):
    layers, path = P.Layers(folder("gold")), folder("states")
    assert RU.refresh_rollup(spark, layers, path) == [] and RU.read_rollup(spark, path) is None
    gold = FX.gold_events(spark, sf).select(*P.GOLD_COLUMNS).withColumn(
        "article_date", F.when(F.length("url") % 7 > 0, F.col("article_date"))).cache()    # some without a day

    def load(df):
        P.write_layer(df.withColumn("processed_at", F.current_timestamp()), layers.path("gold"))

    load(gold.where(F.xxhash64("url") % 3 != 0))
    assert set(RU.refresh_rollup(spark, layers, path)) == set(P.days_of(gold))
    same(RU.read_rollup(spark, path), layers.read(spark, "gold"))
    stamps = dict(RU.read_rollup(spark, path).groupBy("article_date").agg(F.max("rolled_at")).collect())
    assert RU.refresh_rollup(spark, layers, path) == []
    load(gold.where(F.col("article_date") == DAY))                                         # late rows of one day
    assert [str(d) for d in RU.refresh_rollup(spark, layers, path)] == [DAY]
    again = dict(RU.read_rollup(spark, path).groupBy("article_date").agg(F.max("rolled_at")).collect())
    assert [str(d) for d in again if again[d] != stamps[d]] == [DAY]
    same(RU.read_rollup(spark, path), layers.read(spark, "gold"))
    gold.unpersist()


def test_panels_of_a_day_read_one_partition_of_the_rollup(spark, sf):
    layers, path = P.Layers(folder("gold")), folder("states")
    P.write_layer(FX.gold_events(spark, sf).select(*P.GOLD_COLUMNS).withColumn("processed_at", F.current_timestamp()), layers.path("gold"))
    RU.refresh_rollup(spark, layers, path)
    files = Q.flt_date(RU.read_rollup(spark, path), DAY).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all(f"article_date={DAY}" in r.f for r in files)
    plan = RU.panels(RU.read_rollup(spark, path), DAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(article_date" in plan and layers.path("gold") not in plan


@pytest.mark.parametrize("field,ascending", [("heading", True), ("positive_score", False), ("article_date", False)])
def test_stored_pages_equal_offset_and_read_few_parts(spark, sf, field, ascending):
    df = Q.prj_compare_cols(FX.gold_events(spark, sf))
    path, n = folder("order"), df.count()
    SO.store_order(df, path, field, ascending, parts=6)
    for page in (0, 1, 2, 17, n // 15 // 2, n // 15, n // 15 + 1, n // 15 + 2):
        got = [tuple(r) for r in SO.stored_page(spark, path, page, 15, ascending).collect()]
        want = [tuple(r) for r in Q.page_client(df, page, field, ascending, 15).collect()]
        assert got == want, page
    assert SO.stored_page(spark, path, n, 15, ascending).collect() == []
    plan = SO.stored_page(spark, path, 17, 15, ascending)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_part", plan)
    parts = [r._part for r in spark.read.parquet(path + "/directory").collect()]
    assert len(parts) > 3 and spark.read.parquet(path + "/directory").agg(F.sum("n_rows")).first()[0] == n


def test_stored_order_of_ties_and_of_an_empty_table(spark):
    df = spark.createDataFrame([("Same", f"u{i % 4}", i) for i in range(40)] + [(None, "n", 40)], "heading string, url string, x int")
    path = folder("ties")
    SO.store_order(df, path, "heading", parts=4)
    got = [r for p in range(1, 9) for r in SO.stored_page(spark, path, p, 6).collect()]
    assert sorted(r.x for r in got) == list(range(41)) and got[0].heading is None
    SO.store_order(df.limit(0), path + "-none", "heading", parts=4)
    assert SO.stored_page(spark, path + "-none", 1, 6).collect() == []


def test_sheets_of_one_table_equal_the_union_and_are_scanned_once(spark, sf):
    routes = {"english": (R.english_cleaner, False), "native": (T.clean_punjabi, False), "video": (R.english_cleaner, True)}
    one = R.workspace_results_of(FX.workspace_sources(spark, sf), "sheet", routes)
    apart = R.workspace_results(FX.workspace_sheets(spark, sf, R.english_cleaner, T.clean_punjabi))
    assert rows(one) == rows(apart)

    def count(df, node):
        return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count(node)

    assert (count(one, "FileScan parquet"), count(one, "ArrowEvalPython")) == (1, 1)
    assert count(apart, "FileScan parquet") == 3
