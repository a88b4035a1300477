"""Per-group top-n that stays balanced when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, salt: int = 64) -> DataFrame:
    """Rows ranked 1..n within ``group`` by ``order`` (ties broken by the order columns).

    Two rounds: first the top n inside (group, hash bucket) — a hot group is
    spread over ``salt`` tasks — then the top n of those at most ``salt * n``
    candidates per group.  No group is ever sorted whole in one task.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salt))
    w1 = Window.partitionBy(F.col(group), F.col("_b")).orderBy(*order)
    first = (df.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w1))
             .where(F.col("_r") <= n).drop("_r", "_b"))
    w2 = Window.partitionBy(group).orderBy(*order)
    return first.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= n).drop("_r")
