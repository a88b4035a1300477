"""Golden values of the sentiment map, rounding, softmax and label helpers."""

import pytest
from pyspark.sql import functions as F

from presswire.functions import scores as S

GOLDEN = [  # polarity -> (pos, neg, neu, label, alert)
    (0.0, 0.05, 0.05, 0.9, "neutral", False),
    (0.1, 0.2, 0.2, 0.6, "neutral", False),
    (0.5, 0.65, 0.05, 0.3, "positive", False),
    (1.0, 0.9, 0.05, 0.05, "positive", False),
    (-0.15, 0.05, 0.475, 0.475, "negative", False),
    (-0.2, 0.05, 0.5, 0.45, "negative", True),
    (-1.0, 0.05, 0.9, 0.05, "negative", True),
]


def test_sent_map_golden(spark):
    df = spark.createDataFrame([(g[0], "some text") for g in GOLDEN], "p double, t string")
    out = df.select("p", S.sent_map(F.col("p"), F.col("t")).alias("s")).select(
        "p", "s.*", S.sent_alert(F.col("s.negative_score")).alias("alert")).collect()
    got = {r.p: r for r in out}
    for p, pos, neg, neu, label, alert in GOLDEN:
        r = got[p]
        assert (r.positive_score, r.negative_score, r.neutral_score) == pytest.approx((pos, neg, neu), abs=1e-9)
        assert r.sentiment_label == label and r.alert == alert
        assert abs(r.positive_score + r.negative_score + r.neutral_score - 1) <= 2e-4


def test_sent_map_blank_text(spark):
    df = spark.createDataFrame([(0.9, None), (0.9, "  \n")], "p double, t string")
    rows = df.select(S.sent_map(F.col("p"), F.col("t")).alias("s")).select("s.*").collect()
    assert all((r.positive_score, r.negative_score, r.neutral_score, r.sentiment_label) == (0.0, 0.0, 1.0, "neutral")
               for r in rows)


def test_round_half_up(spark):
    r = spark.range(1).select(S.round_half_up(F.lit(2.675), 2).alias("a"), S.round_half_up(F.lit(0.5), 0).alias("b"),
                              S.round_half_up(F.lit(-0.25), 1).alias("c")).first()
    assert r.a in (2.67, 2.68) and r.b == 1.0 and r.c == -0.3


def test_softmax_argmax_reorder(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>")
    r = df.select(S.softmax("z").alias("p")).select(
        "p", S.argmax_label(F.col("p"), ["negative", "neutral", "positive"]).alias("lab"),
        S.reorder_scores(F.col("p")).alias("o")).first()
    assert sum(r.p) == pytest.approx(1.0)
    assert r.lab == "positive"
    assert r.o.positive == pytest.approx(r.p[2]) and r.o.negative == pytest.approx(r.p[0])


def test_band_and_label_default(spark):
    df = spark.createDataFrame([(0.7, "POSITIVE"), (0.5, None), (0.1, "weird")], "a double, l string")
    rows = df.select(S.sentiment_band(F.col("a")).alias("b"), S.label_default(F.col("l")).alias("l")).collect()
    assert [r.b for r in rows] == ["green", "amber", "red"]
    assert [r.l for r in rows] == ["positive", "neutral", "neutral"]


def test_staged_sent_map_equals_single_column(spark):
    """with_sent_map (staged projections) is bit-identical to sent_map (one Column),
    including polarities outside [-1, 1], thresholds, NULL and blank text."""
    grid = [i / 1000.0 for i in range(-1500, 1501, 7)] + [0.1, -0.1, 0.0, 1.0, -1.0, None]
    texts = ["some text", "", " \t ", None]
    rows = [(i, p, texts[i % len(texts)]) for i, p in enumerate(grid)]
    df = spark.createDataFrame(rows, "id int, p double, t string")
    one = df.select("id", S.sent_map(F.col("p"), F.col("t")).alias("s")).select("id", "s.*")
    staged = S.with_sent_map(df, F.col("p"), F.col("t")).select("id", "_s.*")
    assert staged.columns == one.columns
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, staged.collect()))
    assert one.exceptAll(staged).count() == 0 and staged.exceptAll(one).count() == 0


def test_rounding_is_half_away_from_zero(spark):
    from presswire.functions.scores import round_half_up
    rows = spark.createDataFrame([(-0.25,), (0.25,), (-1.5,), (None,), (0.0,), (-0.04,)], "x double")
    got = [r[0] for r in rows.select(round_half_up(rows.x, 1)).collect()]
    assert got == [-0.3, 0.3, -1.5, None, 0.0, 0.0]
