"""Forest pipeline, model hooks, the watermarked daily window, checkpoint folder rules."""

import tempfile

from pyspark.sql import functions as F

from presswire import constants as C
from presswire.operators import models as M
from presswire.session import checkpoint_dir
from presswire.streaming import increments as INC


def _train_rows(spark):
    rows = []
    for i in range(40):
        rows.append((f"cricket match stadium wicket team {i}", "Sports"))
        rows.append((f"court verdict judge petition bail {i}", "Judiciary"))
    return spark.createDataFrame(rows, "text string, label string")


def test_forest_train_predict_proba_save_load(spark):
    data = _train_rows(spark)
    model = M.train_forest(data, trees=10)
    pred = M.forest_predict(data, "text", model, "p").where(F.col("p") != F.col("label")).count()
    assert pred == 0
    proba = M.forest_proba(data.limit(3), "text", model).collect()
    assert all(abs(sum(r.proba.values()) - 1) < 1e-6 and set(r.proba) == {"Sports", "Judiciary"} for r in proba)
    path = tempfile.mkdtemp(prefix="pw-model-", dir="/tmp") + "/m"
    M.save_model(model, path)
    again = M.load_model(path)
    assert again is not None and M.load_model(path + "-missing") is None
    blank = spark.createDataFrame([("   ",)], "text string")
    assert M.forest_predict(blank, "text", again, "p").first().p == C.DEFAULT_CATEGORY


def test_forest_fallback_without_model(spark):
    df = spark.createDataFrame([("police arrested the accused",), ("",)], "text string")
    assert [r.p for r in M.forest_predict(df, "text", None, "p").collect()] == ["Crime", "Politics"]


def test_model_hooks(spark):
    df = spark.createDataFrame([("a good day",), ("",)], "t string")
    out = M.with_model_scores(df, "t", M.hashing_logits_model(3)).select(
        "t", "probs", M.sentiment_from_model(F.col("probs")).alias("s")).collect()
    assert abs(sum(out[0].probs) - 1) < 1e-9 and out[1].probs is None
    assert (out[1].s.positive, out[1].s.negative, out[1].s.neutral) == (0.0, 0.0, 0.0)
    cat = M.with_model_scores(df, "t", M.hashing_logits_model(10)).select(
        M.category_from_model(F.col("probs"), F.col("t")).alias("c")).collect()
    assert cat[0].c in C.MODEL_CATEGORIES and cat[1].c == C.DEFAULT_CATEGORY


def test_daily_stream_equals_batch_with_late_rows_and_replays(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    src, sink, ckpt = (tempfile.mkdtemp(prefix="pw-daily-", dir="/tmp") + "/x" for _ in range(3))
    first = ev.agg(F.min("ts")).first()[0]
    late = F.col("ts") < F.lit(first) + F.expr("INTERVAL 2 DAYS")

    def same(out, rows):
        got = {(r.day, r.event_type): (r.events, round(r.mean_value, 6)) for r in out.collect()}
        want = {(r.day, r.event_type): (r.n, round(r.m, 6)) for r in rows.groupBy(
            F.col("ts").cast("date").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m")).collect()}
        assert got == want and want   # open days included

    ev.where(~late | (F.col("event_id") % 2 == 0)).repartition(3).write.parquet(src)
    same(INC.stream_daily(spark, src, sink, ckpt, files_per_batch=1), ev.where(~late | (F.col("event_id") % 2 == 0)))
    # rows weeks behind the newest
    ev.where(late & (F.col("event_id") % 2 == 1)).coalesce(1).write.mode("append").parquet(src)
    same(INC.stream_daily(spark, src, sink, ckpt, files_per_batch=1), ev)
    replay = spark.read.parquet(sink).where("batch_id = 'b0'").count()
    assert replay
    same(INC.stream_daily(spark, src, sink, ckpt), ev)       # nothing new
    INC.compact_daily(spark, sink, sink + "-compact")
    same(INC.daily_window(spark, sink + "-compact"), ev)
    assert spark.read.parquet(sink + "-compact").select("day", "event_type").distinct().count() == spark.read.parquet(sink + "-compact").count()


def test_a_replayed_batch_adds_nothing(spark, sf):
    ev, sink = spark.read.parquet(f"{sf}/events.parquet"), tempfile.mkdtemp(prefix="pw-up-", dir="/tmp") + "/s"
    for batch in ("b0", "b1", "b1"):
        INC.upsert_daily(ev.where(F.col("event_id") % 2 == int(batch == "b1")), sink, batch)
    assert INC.daily_window(spark, sink).agg(F.sum("events")).first()[0] == ev.count()


def test_checkpoint_dir_reuses_setting(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    assert spark.conf.get("spark.checkpoint.dir")


def test_forest_keeps_a_text_column_and_accented_words(spark):
    rows = [(f"été müller {i}", "a") for i in range(6)] + [(f"other words {i}", "b") for i in range(6)]
    model = M.train_forest(spark.createDataFrame(rows, "body string, label string"), "body", "label", trees=3)
    assert {"été", "müller"} <= {w.lower() for w in model.stages[5].vocabulary}
    one = spark.createDataFrame([("keep me", "été müller 3")], "text string, body string")
    assert M.forest_predict(one, "body", model, "p").first().text == "keep me"
    assert M.forest_proba(one, "body", model).first().text == "keep me"


def test_forest_on_labels_beats_chance_on_held_out_rows_for_both_classes(spark):
    from presswire.plans.registry_misc import _FITTED, _forest, _labelled
    sf = "/root/testdata/sf0.01"
    model = _forest(spark, sf)
    rows = M.forest_predict(_labelled(spark, sf), "text", model, "p").where("held_out").select("label", "p").collect()
    share = {x: [r.p == x for r in rows if r.label == x] for x in ("0", "1")}
    assert all(len(x) >= 10 for x in share.values())
    assert sum(sum(x) / len(x) for x in share.values()) / 2 > 0.65, {k: (sum(v), len(v)) for k, v in share.items()}
    assert (spark.sparkContext.applicationId, sf) in _FITTED


def test_forest_bound_and_balance(spark):
    rows = [(f"cricket match team {i}", "Sports") for i in range(60)] + [(f"court judge bail {i}", "Judiciary") for i in range(4)]
    data = spark.createDataFrame(rows, "text string, label string")
    model = M.train_forest(data, trees=5, balanced=True)
    got = M.forest_predict(data, "text", model, "p").where("p = label").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {"Sports": 60, "Judiciary": 4}
    few = M.train_forest(data, trees=2, max_rows=10, vocab=8)
    assert len(few.stages[5].vocabulary) <= 8
