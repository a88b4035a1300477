"""Training rows of the forest are chosen without gathering texts in one task."""

from pyspark.sql import functions as F

from presswire.operators import models as M


def test_training_rows_are_the_lowest_and_stay_spread(spark):
    rows = [(f"text {i % 700}", str(i % 3)) for i in range(2000)] + [("copy", "1")] * 500 + [(None, None)]
    df = spark.createDataFrame(rows, "t string, label string").repartition(8)
    hashes = sorted(r[0] for r in df.select(F.xxhash64("t", "label")).collect())
    copy = df.where("t = 'copy'").select(F.xxhash64("t", "label")).first()[0]
    within = hashes.index(copy) + 250       # the bound falls among the copies of one row
    for n in (1, 40, within, 2501, 9999):
        got, near = M.lowest_by_hash(df, ["t", "label"], n)
        assert sorted(r[0] for r in got.select(F.xxhash64("t", "label")).collect()) == hashes[:n]
        assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()
        near.unpersist()


def test_training_plan_sends_no_text_to_one_task(spark, monkeypatch):
    seen = []

    class Fit:
        def fit(self, data):
            seen.append(data._jdf.queryExecution().toString())
            raise RuntimeError("seen")

    monkeypatch.setattr(M, "forest_pipeline", lambda *a, **k: Fit())
    df = spark.createDataFrame([(f"t{i}", str(i % 2)) for i in range(100)], "text string, label string")
    try:
        M.train_forest(df, balanced=True, max_rows=10)
    except RuntimeError:
        pass
    assert seen and "TakeOrdered" not in seen[0] and "GlobalLimit" not in seen[0]


def test_bounded_training_rows_come_in_parts_sorted_by_hash(spark, monkeypatch):
    seen = []

    class Fit:
        def fit(self, data):
            seen.append([[r[0] for r in part] for part in data.select(F.xxhash64(M.TEXT, "label")).rdd.glom().collect()])
            raise RuntimeError("seen")

    monkeypatch.setattr(M, "forest_pipeline", lambda *a, **k: Fit())
    monkeypatch.setattr(M, "FIT_ROWS", 30)
    df = spark.createDataFrame([(f"t{i}", str(i % 2)) for i in range(100)], "text string, label string").repartition(7)
    for n, parts in ((20, 1), (90, 3), (1000, 4)):
        try:
            M.train_forest(df, balanced=True, max_rows=n)
        except RuntimeError:
            pass
        got = [h for part in seen[-1] for h in part]
        assert got == sorted(r[0] for r in df.select(F.xxhash64("text", "label")).collect())[:n] and len(seen[-1]) == parts
