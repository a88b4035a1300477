"""Catalogue properties on the events-derived gold fixture."""

import pytest
from pyspark.sql import functions as F

from presswire.plans import catalog as Q
from presswire.plans import fixtures as FX


@pytest.fixture(scope="module")
def gold(spark, sf):
    return FX.gold_events(spark, sf).cache()


def test_panels_sum_to_total(gold):
    total = Q.agg_total(gold).first().total
    dist = {r.name: r.value for r in Q.agg_sentiment_dist(gold).collect()}
    assert sum(dist.values()) == total
    panels = Q.agg_panels(gold)
    by_panel = {r.panel: r.n for r in panels.groupBy("panel").agg(F.sum("cnt").alias("n")).collect()}
    assert all(v == total for v in by_panel.values()) and len(by_panel) == 7


def test_alert_iff_negative(gold):
    bad = gold.where(F.col("is_negative_alert") != (F.col("negative_score") >= 0.5)).count()
    assert bad == 0


def test_paging(gold):
    info = Q.page_info(gold, page=1, per_page=7).first()
    assert info.pages == -(-info.total // 7)
    p1 = [r.url for r in Q.page_offset(gold, 1, 7, sort_by="negative_score").collect()]
    p2 = [r.url for r in Q.page_offset(gold, 2, 7, sort_by="negative_score").collect()]
    assert len(p1) == 7 and not set(p1) & set(p2)
    with pytest.raises(ValueError):
        Q.page_offset(gold, 0, 7)
    with pytest.raises(ValueError):
        Q.page_offset(gold, 1, 101)


def test_sort_whitelist_fallback():
    assert Q.sort_column("positive_score") == "positive_score"
    assert Q.sort_column("heading; DROP TABLE x") == "article_date"


def test_in_list_needs_two():
    with pytest.raises(ValueError):
        Q.parse_channel_list("click, ")
    assert Q.parse_channel_list(" click , view,") == ["click", "view"]


def test_search_wildcards(gold):
    like = Q.flt_search(gold, "story 1_").count()
    literal = Q.flt_search(gold, "story 1_", literal=True).count()
    assert like >= literal == 0


def test_trend_modes_small_series(spark):
    for n in (5, 7, 13, 14, 20):
        rows = [(f"2024-01-{i + 1:02d}", 0.1 + i / 100, 0.2) for i in range(n)]
        t = spark.createDataFrame(rows, "d string, avg_positive double, avg_negative double").select(
            F.col("d").cast("date").alias("article_date"), "avg_positive", "avg_negative")
        r = Q.win_recent_vs_first(t).first()
        k = min(7, n)
        assert r.recent_pos == pytest.approx(sum(x[1] for x in rows[-k:]) / k)
        assert r.older_pos == pytest.approx(sum(x[1] for x in rows[:k]) / k)


def test_result_independent_of_partitioning(gold):
    a = sorted(tuple(r) for r in Q.agg_channel_stats(gold).collect())
    b = sorted(tuple(r) for r in Q.agg_channel_stats(gold.repartition(3)).collect())
    assert a == b


def test_keyset_pages_walk_the_whole_feed(spark, sf):
    rows = [(f"u{i}", None if i % 7 == 0 else i % 3 / 10) for i in range(40)]
    gold = FX.gold_events(spark, sf).limit(0)
    made = spark.createDataFrame(rows, "url string, negative_score double")
    feed = gold.unionByName(made, allowMissingColumns=True)
    whole = [r.url for r in Q.page_offset(feed, 1, 100, sort_by="negative_score").collect()]
    got, last = [], None
    while page := Q.page_after(feed, last, 9, sort_by="negative_score").collect():
        got += [r.url for r in page]
        last = (page[-1].negative_score, page[-1].url)
    assert got == whole and len(got) == 40
