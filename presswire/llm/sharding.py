"""Feistel shuffle with cycle walking: a reproducible permutation of global row numbers, shards and slots."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import numbered, tune

ROUNDS = 6
#: Steps of a walk that are unrolled; see ``permuted``.
WALK = 64


def halves(n: int) -> tuple[int, int]:
    """The smallest near-square domain a * b >= n: at most a - 1 of its points lie outside 0..n-1."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _div(x: Column, by: int) -> Column:
    """Whole quotient of longs (``/`` would go through doubles)."""
    return F.call_function("div", x.cast("long"), F.lit(by).cast("long"))


def _turn(x: Column, n: int, seed: int, back: bool) -> Column:
    """One pass of the Feistel network over Z_a x Z_b (Black and Rogaway's generalised form)."""
    a, b = halves(n)
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    sign = -1 if back else 1

    def step(s: Column, k: Column) -> Column:
        f = F.xxhash64(F.lit(seed).cast("long"), k.cast("long"), F.when(k % 2 == 0, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(k % 2 == 0, F.pmod(s["l"] + sign * F.pmod(f, F.lit(a).cast("long")), F.lit(a))).otherwise(s["l"]).alias("l"),
            F.when(k % 2 == 0, s["r"]).otherwise(F.pmod(s["r"] + sign * F.pmod(f, F.lit(b).cast("long")), F.lit(b).cast("long"))).alias("r"))

    left = F.pmod(x, F.lit(a).cast("long"))
    start = F.struct(left.alias("l"), _div(x - left, a).alias("r"))
    return F.aggregate(F.array(*[F.lit(k) for k in rounds]), start, step,
                       lambda s: s["r"] * F.lit(a).cast("long") + s["l"])


def permuted(x: Column, n: int, seed: int, back: bool = False) -> Column:
    """Position in 0..n-1 of row number ``x`` (``back``: the row number at position ``x``).

    The walk repeats the network while the point lies outside 0..n-1.  A walk can pass at most
    a - 1 outside points, so 64 steps always end it up to 4096 rows; beyond that a share of under
    1 / a of the points lies outside and a longer walk has a chance under a^-64: then the query
    fails rather than give a wrong slot.
    """
    n = max(n, 1)
    step = lambda p, _: F.when(p >= F.lit(n), _turn(p, n, seed, back)).otherwise(p)
    got = F.aggregate(F.sequence(F.lit(1), F.lit(min(WALK, halves(n)[0]))), _turn(x, n, seed, back), step)
    return F.when(got < F.lit(n), got).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def shard_and_slot(row: Column, n: int, shards: int, seed: int) -> tuple[Column, Column]:
    """Where row number ``row`` of ``n`` goes: computable for any row without looking at the others."""
    p = permuted(row, n, seed)
    return F.pmod(p, F.lit(shards)).cast("int"), _div(p, shards)


def row_at(shard: Column, slot: Column, n: int, shards: int, seed: int) -> Column:
    """The row number that sits in ``slot`` of ``shard``: the inverse of ``shard_and_slot``."""
    return permuted(slot * F.lit(shards).cast("long") + shard, n, seed, back=True)


def feistel_shards(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Every document's shard and slot under the law `rows` (shard sizes differ by at most one row).

    Global row numbers follow (doc_id, text checksum, size); a permutation of 0..n-1 keyed by
    ``seed`` shuffles them; position p goes to shard p mod shards, slot p div shards.

    Returns doc_id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null: the
    law is not `key`), row_number.
    Nulls: a null text counts as empty (size 1, checksum 0); a null doc_id sorts first.  Ties and
    repeated rows are numbered one after the other.  An empty table gives no rows.  Extra columns
    are not read.  Rows with equal texts are dealt like any others.
    """
    tune(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                         F.crc32(text).alias("text_crc32"))
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "size"], "row_number", "op3")
    shard, slot = shard_and_slot(F.col("row_number"), n, shards, seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"),
                       slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
