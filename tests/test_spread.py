"""spread(): rows kept, work spread over the cores when a scan plans too few tasks."""

from pyspark.sql import functions as F

from presswire.plans import catalog as Q
from presswire.sources.tables import read_table, spread


def test_spread_keeps_rows_and_parallelises(spark, sf):
    docs = read_table(spark, sf, "documents")
    cores = spark.sparkContext.defaultParallelism
    out = spread(docs, "doc_id")
    if docs.rdd.getNumPartitions() < cores:
        assert out.rdd.getNumPartitions() == cores
    assert out.count() == docs.count()
    assert out.exceptAll(docs).count() == 0 and docs.exceptAll(out).count() == 0


def test_spread_modes(spark, sf):
    docs = read_table(spark, sf, "documents")
    try:
        spark.conf.set("presswire.spread", "never")
        assert spread(docs, "doc_id") is docs
        spark.conf.set("presswire.spread", "always")
        assert spread(docs, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    finally:
        spark.conf.unset("presswire.spread")


def test_ordered_top_k_matches_plain_sort(spark, sf):
    """The materialising sort gives the same top rows as a plain orderBy."""
    from presswire.plans import fixtures as FX
    gold = FX.gold_events(spark, sf)
    plain = gold.orderBy(F.desc("negative_score"), "url").limit(7).select("url", "negative_score").collect()
    mat = Q.ordered(gold, F.desc("negative_score"), "url").limit(7).select("url", "negative_score").collect()
    assert plain == mat
