"""pipeline_daily at size: texts dealt out once per layer, each body lowered once, days readable by many tasks."""

import glob
import tempfile

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from presswire.operators import enrich as E
from presswire.operators.rules import silver_rules
from presswire.plans import pipeline as P
from presswire.sources import files

BODY = "words enough for an article of the day " * 3


def test_batch_meets_bronze_without_a_join(spark):
    layers = P.Layers(tempfile.mkdtemp(prefix="pw-meet-", dir="/tmp"))

    def rows(*found):
        return spark.createDataFrame([(h, BODY, "c", u, "ch", d) for h, u, d in found], files.RAW_SCHEMA)

    P.add_bronze(spark, layers, rows(("b", "u1", "2024-01-01"), ("b", "u2", "2024-01-01"), ("b", None, "?"), ("b", "u9", "2024-01-09")))
    batch = P.to_bronze(rows(("a", "u1", "2024-01-01"), ("z", "u1", "2024-01-01"), ("c", "u2", "2024-01-01"), ("b", None, "?"),
                             ("b", "u1", "2024-01-02"), ("d", None, "?"), ("d", None, "?")))
    flagged = P.against_bronze(batch, layers.read(spark, "bronze"), P.days_of(batch))
    got = sorted((r.heading, str(r.url), str(r.article_date), r._state) for r in flagged.collect())
    assert got == [("a", "u1", "2024-01-01", "lower"), ("b", "None", "None", "held"), ("b", "u1", "2024-01-02", "new"),
                   ("c", "u2", "2024-01-01", "held"), ("d", "None", "None", "new")]
    plan = flagged._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_a_body_is_lowered_once(spark):
    df = spark.createDataFrame([("h", BODY + "It's good, Edited By: x", "u"), ("h", BODY + "DEAR Subscriber", "v")],
                               "heading string, body string, url string")
    out = silver_rules(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 2 and plan.count("substring_index(") == 1     # the heading's and the body's
    assert [(r.url, r.body_cleaned.split()[-1]) for r in out.collect()] == [("u", "good")]


def test_polarity_names_the_tokens_without_pairing_them_all(spark):
    texts = ["good", "not good", "not not good bad", "good not", "", None, "nothing here", "not x good", "terrible  not good"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", E.lexicon_polarity(F.col("t")).alias("p"))
    assert "zip_with" not in df._jdf.queryExecution().optimizedPlan().toString()
    good, bad, terrible = 0.6875, -0.6875, -1.0
    assert [r.p for r in df.orderBy("k").collect()] == [good, -good / 2, (-good / 2 + bad) / 2, good, 0.0, 0.0, 0.0, good,
                                                        (terrible - good / 2) / 2]


def test_a_day_has_several_row_groups(spark):
    path = tempfile.mkdtemp(prefix="pw-groups-", dir="/tmp") + "/t"
    noise = F.concat(*[F.sha2(F.concat_ws("-", "id", F.lit(i)), 512) for i in range(8)])
    P.write_layer(spark.range(20_000).select("id", noise.alias("body"), F.lit("2024-01-01").cast("date").alias("article_date")).coalesce(1), path)
    found = [pq.ParquetFile(x).metadata for x in glob.glob(path + "/*/*.parquet")]
    assert sum(m.num_rows for m in found) == 20_000
    assert max(m.row_group(i).total_byte_size for m in found for i in range(m.num_row_groups)) < 3 * P.ROW_GROUP
