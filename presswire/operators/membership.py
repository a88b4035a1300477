"""Bloom filters over dictionary columns, tested on what a row gives off before it is shuffled.

The filter is an array of longs in a one-row table: its size has a fixed bound, so it may travel to every
task as a scalar subquery.  A dictionary too large for its bound only
makes more tokens pass; the join behind the filter decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest filter: 2^21 bits, 256 kB.
MOST_BITS = 1 << 21
#: Bits per dictionary entry; three probes of it let about one foreign token in 50 pass.
BITS_PER_ENTRY = 10
PROBES = 3


def _slots(value: Column, bits: int) -> list[Column]:
    """The filter's bits that stand for ``value``."""
    return [F.pmod(F.xxhash64(value, F.lit(k)), F.lit(bits).cast("bigint")) for k in range(PROBES)]


def filter_bits(entries: int, most: int = MOST_BITS) -> int:
    """Bits for a dictionary of this size: a power of two, 64 at least, ``most`` at most."""
    want = 64
    while want < min(most, entries * BITS_PER_ENTRY):
        want *= 2
    return want


def bloom_filter(words: DataFrame, column: str, bits: int, slots: Callable[[Column, int], list[Column]] = _slots) -> DataFrame:
    """One row (_bloom array<bigint>) with the bits of all values of ``column``; nulls have none."""
    one = F.lit(1).cast("bigint")
    slot = words.where(F.col(column).isNotNull()).select(F.explode(F.array(*slots(F.col(column), bits))).alias("slot"))
    blocks = slot.groupBy(F.expr("slot div 64").alias("block")).agg(
        F.bit_or(F.call_function("shiftleft", one, (F.col("slot") % 64).cast("int"))).alias("word"))
    every = words.sparkSession.range(bits // 64).select(F.col("id").alias("block"))
    dense = every.join(blocks, "block", "left").select("block", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))
    return dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("block", "word"))), lambda x: x["word"]).alias("_bloom"))


def might_contain(bloom: Column, value: Column, bits: int) -> Column:
    """False only for values that the dictionary does not hold."""
    hit = value.isNotNull()
    for slot in _slots(value, bits):
        word = F.get(bloom, F.call_function("shiftright", slot, F.lit(6)).cast("int"))
        one = F.getbit(word, (slot % 64).cast("int")) == 1
        hit = hit & one
    return F.coalesce(hit, F.lit(False))


def where_held(df: DataFrame, value: Column, words: DataFrame, column: str, always: Column | None = None,
               most: int = MOST_BITS) -> DataFrame:
    """The rows of ``df`` whose ``value`` may be in ``column`` of ``words``, and those that ``always`` keeps.

    The filter is a scalar subquery, made once per query.  Behind an explode it works in the same stage, so that
    what the dictionary lacks is never shuffled.
    """
    bits = filter_bits(words.count(), most)
    kept = might_contain(bloom_filter(words, column, bits).scalar(), value, bits)
    return df.where(kept if always is None else always | kept)
