"""Rows appended in batches are worked out once."""

from pyspark.sql import functions as F

from presswire.plans import registry_extra as RE


def test_appended_rows_are_worked_out_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(x):
        runs.add(1)
        return x

    rows = spark.range(40).select(F.udf(counted, "long")("id").alias("id"),
                                  F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int") % 4).alias("article_date"))
    got = RE._appended(spark, rows, "stamp")
    assert sorted(r.id for r in got.collect()) == list(range(40)) and runs.value == 40
