"""Layered loads: idempotent reruns, CSV round trip, streaming equals batch."""

import os
import random
import tempfile

from pyspark.sql import functions as F

from presswire.plans import fixtures as FX
from presswire.plans import pipeline as P
from presswire.sources import files
from presswire.streaming import increments as INC


def _raw(spark, sf):
    return FX.raw_documents(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in files.RAW_COLUMNS])


def test_csv_round_trip_with_newlines_and_quotes(spark):
    d = tempfile.mkdtemp(prefix="pw-csv-", dir="/tmp")
    rows = [("a \"quoted\"\nheading", "body, with comma\nand newline", "cat", "https://x/1", "ch", "2024-01-01"),
            ("h2", "b2", None, "https://x/2", "ch", "not-a-date")]
    df = spark.createDataFrame(rows, files.RAW_SCHEMA)
    files.write_raw_csv(df, d + "/f.csv")
    back = files.read_raw_csv(spark, d + "/f.csv").orderBy("url").collect()
    assert back[0].heading == rows[0][0] and back[0].body == rows[0][1]
    bronze = P.to_bronze(files.read_raw_csv(spark, d + "/f.csv"))
    assert bronze.where(F.col("article_date").isNull()).count() == 1   # bad date -> NULL, not an error


def test_rerun_changes_nothing(spark, sf):
    root = tempfile.mkdtemp(prefix="pw-raw-", dir="/tmp")
    raw = _raw(spark, sf)
    days = [r[0] for r in raw.select("article_date").distinct().orderBy("article_date").limit(2).collect()]
    for day in days:
        files.write_raw_csv(raw.where(F.col("article_date") == day), files.daily_path(root, day))
    layers = P.Layers(tempfile.mkdtemp(prefix="pw-wh-", dir="/tmp"))
    first = P.run_day(spark, layers, root, days[0])
    counts = {x: layers.read(spark, x).count() for x in ("bronze", "silver", "gold")}
    again = P.run_day(spark, layers, root, days[0])
    assert first["bronze"]["status"] == "loaded" and again["bronze"]["status"] == "already ingested"
    assert {x: layers.read(spark, x).count() for x in ("bronze", "silver", "gold")} == counts
    P.run_day(spark, layers, root, days[1])
    assert layers.read(spark, "bronze").select("article_date").distinct().count() == 2
    assert P.run_day(spark, layers, root, "1999-01-01")["bronze"]["status"] == "no file"


def test_stream_equals_batch(spark, sf):
    root = tempfile.mkdtemp(prefix="pw-sraw-", dir="/tmp")
    raw = _raw(spark, sf)
    days = [r[0] for r in raw.select("article_date").distinct().orderBy("article_date").limit(3).collect()]
    for day in days:
        files.write_raw_csv(raw.where(F.col("article_date") == day), files.daily_path(root, day))
    s_layers = P.Layers(tempfile.mkdtemp(prefix="pw-swh-", dir="/tmp"))
    INC.stream_bronze(spark, s_layers, root, os.path.join(tempfile.mkdtemp(dir="/tmp"), "ckpt"))
    b_layers = P.Layers(tempfile.mkdtemp(prefix="pw-bwh-", dir="/tmp"))
    P.run_day(spark, b_layers, root, "*")
    cols = ["url", "category", "positive_score", "sentiment_label", "article_date"]
    a = sorted(tuple(r) for r in s_layers.read(spark, "gold").select(*cols).collect())
    b = sorted(tuple(r) for r in b_layers.read(spark, "gold").select(*cols).collect())
    assert a == b and a


def test_a_day_in_several_files_and_bad_dates(spark):
    root = tempfile.mkdtemp(prefix="pw-parts-", dir="/tmp")
    body = "words enough for an article of the day " * 3
    one = [(f"h{i}", body, "c", f"https://x/{i}", "ch", "2024-01-05") for i in range(12)]
    two = [(f"h{i}", body, "c", f"https://x/{i}", "ch", "2024-01-05") for i in range(9, 23)]
    bad = [("hb", body, "c", "https://x/bad", "ch", "soon")]
    layers = P.Layers(tempfile.mkdtemp(prefix="pw-parts-wh-", dir="/tmp"))
    ckpt = os.path.join(tempfile.mkdtemp(dir="/tmp"), "ckpt")
    for k, rows in enumerate((one, two + bad)):
        files.write_raw_csv(spark.createDataFrame(rows, files.RAW_SCHEMA), f"{root}/part{k}.csv")
        INC.stream_bronze(spark, layers, root, ckpt)
    bronze = layers.read(spark, "bronze")
    assert bronze.where("article_date is not null").count() == 23 and bronze.where("article_date is null").count() == 1
    assert layers.read(spark, "gold").select("url").distinct().count() == layers.read(spark, "gold").count() == 24
    again = P.add_bronze(spark, layers, spark.createDataFrame(two + bad, files.RAW_SCHEMA))
    assert again["status"] == "already ingested" and layers.read(spark, "bronze").count() == 24
    batch = P.add_bronze(spark, layers, spark.createDataFrame([("hc", body, "c", "https://x/worse", "ch", "?")], files.RAW_SCHEMA))
    assert batch["bad_dates"] == 1


def test_days_reach_the_scan(spark, sf):
    layers = P.Layers(tempfile.mkdtemp(prefix="pw-prune-", dir="/tmp"))
    P.add_bronze(spark, layers, _raw(spark, sf))
    day = [d for d in P.days_of(layers.read(spark, "bronze")) if d][0]
    plan = P.on_days(layers.read(spark, "bronze"), [day])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [article_date" in plan.replace("isnotnull(article_date#", "article_date#") or "PartitionFilters: []" not in plan


def test_articles_without_url_are_named_by_heading_and_body(spark):
    layers = P.Layers(tempfile.mkdtemp(dir="/tmp"))

    def add(*rows):
        rows = [(h, b, "c", None, "ch", day) for h, b, day in rows]
        return P.add_bronze(spark, layers, spark.createDataFrame(rows, files.RAW_SCHEMA))["rows"]

    assert add(("h", "one", "2024-01-01"), (None, "two", "2024-01-01"), (None, None, "?")) == 3
    later = [("h", "other", "2024-01-01"), (None, "three", "2024-01-01"), ("", "two", "2024-01-01"), (None, "", "?"), ("", None, "?")]
    assert add(*later) == 5
    assert add(*later, ("h", "one", "2024-01-01"), (None, None, "?")) == 0
    assert layers.read(spark, "bronze").count() == 8


BODY = "words enough for an article of the day " * 3


def _bronze(spark, layers):
    return sorted((tuple(r) for r in layers.read(spark, "bronze").drop("ingested_at").collect()), key=str)


def test_any_batching_gives_the_same_bronze(spark):
    rng = random.Random(11)
    rows = [(f"h{rng.randint(0, 3)}", BODY + str(rng.randint(0, 2)), "c", f"https://x/{rng.randint(0, 9)}", "ch",
             f"2024-01-0{rng.randint(1, 2)}") for _ in range(40)]
    rows += [("h", BODY, "c", None, "ch", "2024-01-01"), ("h", BODY, "c", None, "ch", "2024-01-01"), (None, None, None, None, None, "?")]
    want = {}
    for h, b, c, u, ch, day in rows:
        key = (day, u or ("content", h, b))
        want[key] = min(want.get(key, (h, b)), (h, b), key=str)
    seen = []
    for k in (1, 3, 7):
        rng.shuffle(rows)
        layers = P.Layers(tempfile.mkdtemp(prefix="pw-any-", dir="/tmp"))
        for i in range(k):
            P.add_bronze(spark, layers, spark.createDataFrame(rows[i::k], files.RAW_SCHEMA))
        seen.append(_bronze(spark, layers))
        again = P.add_bronze(spark, layers, spark.createDataFrame(rows, files.RAW_SCHEMA))
        assert again["rows"] == 0 and _bronze(spark, layers) == seen[-1]
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(want)
    assert {(r[0], r[1]) for r in seen[0]} == set(want.values())


def test_stream_in_batches_of_one_file_equals_one_batch(spark):
    root = tempfile.mkdtemp(prefix="pw-one-", dir="/tmp")
    for k in range(4):
        rows = [(f"h{(i + k) % 3}", BODY, "c", f"https://x/{i}", "ch", "2024-01-05") for i in range(k, k + 4)]
        files.write_raw_csv(spark.createDataFrame(rows, files.RAW_SCHEMA).coalesce(1), f"{root}/part{k}.csv")
    got = []
    for n in (1, None):
        layers = P.Layers(tempfile.mkdtemp(prefix="pw-one-wh-", dir="/tmp"))
        ckpt = os.path.join(tempfile.mkdtemp(dir="/tmp"), "ckpt")
        INC.stream_bronze(spark, layers, root, ckpt, files_per_batch=n)
        got.append((_bronze(spark, layers), sorted(r.url for r in layers.read(spark, "gold").collect())))
    assert got[0] == got[1] and len(got[0][0]) == 7


def test_late_articles_reach_silver_and_gold_by_default(spark):
    layers = P.Layers(tempfile.mkdtemp(prefix="pw-late-", dir="/tmp"))

    def add(*urls):
        rows = [("h", BODY, "c", u, "ch", "2024-01-05") for u in urls]
        P.add_bronze(spark, layers, spark.createDataFrame(rows, files.RAW_SCHEMA))
        return P.load_silver(spark, layers)["status"], P.load_gold(spark, layers)["status"]

    assert add("https://x/1") == ("loaded", "loaded")
    assert add("https://x/2") == ("loaded", "loaded")
    assert add("https://x/2") == ("nothing new", "nothing new")
    assert {r.url for r in layers.read(spark, "gold").collect()} == {"https://x/1", "https://x/2"}
    assert P.load_silver(spark, layers, rebuild=True)["rows"] == 2


def test_appended_batches_and_dates_from_a_table(spark, sf):
    path = tempfile.mkdtemp(prefix="pw-append-", dir="/tmp") + "/t"
    rows = spark.createDataFrame([(i, f"2024-01-0{i % 3 + 1}") for i in range(9)], "i int, d string").select(
        "i", F.col("d").cast("date").alias("article_date"))
    for batch, part in (("a", rows.where("i < 5")), ("b", rows.where("i >= 5")), ("b", rows.where("i >= 5"))):
        P.append_batch(part, path, batch)
    table = P.catalog_table(spark, path, "appended_in_a_test")
    assert sorted(r.i for r in table.collect()) == list(range(9))
    runs_path = tempfile.mkdtemp(prefix="pw-runs-", dir="/tmp") + "/r"
    spark.createDataFrame([("2024-01-02", "due"), ("2024-01-03", "done")], "d string, status string").select(
        F.col("d").cast("date").alias("run_date"), "status").write.parquet(runs_path)
    got = P.scan_by_date(table, spark.read.parquet(runs_path))
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.i for r in got.collect()) == [1, 4, 7]
    spark.sql("DROP TABLE appended_in_a_test")


def test_no_alerts_leave_no_output(spark):
    path = tempfile.mkdtemp(prefix="pw-alerts-", dir="/tmp") + "/a"
    df = spark.createDataFrame([("h", 49.9), ("i", 50.0)], "Heading string, Negative double")
    assert not files.write_alerts(df.where("Negative < 50"), path) and not os.path.exists(path)
    assert files.write_alerts(df, path) and spark.read.parquet(path).count() == 1
