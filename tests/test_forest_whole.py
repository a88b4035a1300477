"""The forest is fitted on every labelled row that isn't held out, and its thresholds come from all of them."""

import tempfile

from pyspark.sql import functions as F

from presswire.operators import models as M


def test_registered_forest_is_fitted_on_all_rows_not_held_out(spark):
    from presswire.plans.registry_misc import _forest, _labelled
    sf, n = tempfile.mkdtemp(prefix="pw-forest-", dir="/tmp"), 72_000
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    good = (F.col("doc_id") % 3 == 0).cast("int")
    ids.select("doc_id", F.concat_ws(" ", F.lit("alpha"), F.when(good == 1, "fine").otherwise("poor"), F.concat(
        F.lit("w"), F.col("doc_id") % 20)).alias("text")).write.parquet(f"{sf}/documents.parquet")
    ids.select("doc_id", good.alias("quality")).write.parquet(f"{sf}/labels.parquet")
    model, seen = _forest(spark, sf), _labelled(spark, sf).where("not held_out").count()
    assert seen > 50_000 and model.stages[6].numDocs == seen
    assert M.forest_predict(_labelled(spark, sf), "text", model, "p").where("p <> label").count() == 0


def test_thresholds_see_words_of_few_rows(spark):
    rows = 60_000
    df = spark.range(rows).select(F.when(F.col("id") < 2, "alpha gamma").otherwise("alpha").alias("text"),
                                  F.when(F.col("id") < 2, "1").otherwise("0").alias("label"))
    model = M.train_forest(df, balanced=True, trees=20)
    got = M.forest_predict(df, "text", model, "p").where("p = label").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"0": rows - 2, "1": 2}


def test_all_rows_are_dealt_alike_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "LOT", 10)
    rows = [(f"text {i}", str(i % 2)) for i in range(300)] + [("copy", "1")] * 605 + [("", None)] * 7
    df = spark.createDataFrame(rows, f"{M.TEXT} string, label string")
    one, two = (M.dealt(df.repartition(k), 6).rdd.glom().map(lambda part: [tuple(r) for r in part]).collect() for k in (1, 9))
    assert one == two and len(one) == 6
    assert sorted(map(str, (r for part in one for r in part))) == sorted(map(str, rows))
    copies = [part.count(("copy", "1")) for part in one]
    assert max(copies) < 605 / 2 and sum(c > 0 for c in copies) >= 5
