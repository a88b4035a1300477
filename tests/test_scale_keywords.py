"""Windows are cut only where a keyword's gram may lie."""

from pyspark.sql import functions as F

from presswire.operators import enrich as E


def test_keyword_windows_are_not_made_by_a_pattern_at_every_character(spark):
    df = spark.createDataFrame([(1, "the rare Zebra ai"), (2, None), (3, "xİ 😀zebra")], "id int, t string")
    kw = spark.createDataFrame([("A", 0, "zebra"), ("B", 1, "ai"), ("C", 2, "😀z")], "category string, rank int, keyword string")
    sent = E.keyword_candidates(df, "id", "t", E.gram_index(df, "t", kw))
    assert "regexp_extract_all" not in sent._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.id, k) for r in sent.where("window is not null").collect() for k in ("zebra", "ai", "😀z") if k in r.window}
    assert found == {(1, "zebra"), (1, "ai"), (3, "zebra"), (3, "😀z")}
    assert sent.where("window is null").count() == 3
