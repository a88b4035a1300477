"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswire.llm.common import WORD, stored, tune

WEIGHTS = (3, 1, 2)
GROWTH = 1.5
MOST_REPEATS = 2
#: Words of one shard of a source (before hashing spreads them), and the number of shards at which
#: shards grow instead: the quota table has at most MOST_SHARDS + number of sources rows.
SHARD_WORDS = 1 << 17
MOST_SHARDS = 1 << 20
#: Rows of the table of sources up to which it is broadcast (under 1 MB); beyond, the planner joins it.
MOST_BROADCAST = 10_000


def targets(sizes: list[int], weights: list[float], growth: float = GROWTH,
            most: float = MOST_REPEATS) -> list[float]:
    """Share growth * total by weight; a target stops at most * size, the excess goes to the others by weight."""
    total = growth * sum(sizes)
    got, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = total
    while open_:
        w = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / w >= most * sizes[i]]
        if not full:
            for i in open_:
                got[i] = left * weights[i] / w
            break
        for i in full:
            got[i] = float(most * sizes[i])
        # later rounds share what the full sources leave over
        left = total - sum(got)
        open_ = [i for i in open_ if i not in set(full)]
    return got


def sainte_lague(votes, seats: int, most=None):
    """Seats by highest quotients votes / (2 k + 1), at most ``most`` each; ties go to the lower index.

    Every seat whose quotient is above a common divisor is given in one vectorised step; only the
    few seats around the divisor (under one per party) are compared one by one.
    """
    import numpy as np

    votes = np.asarray(votes, dtype=np.float64)
    most = np.full(len(votes), np.iinfo(np.int64).max // 2) if most is None else np.asarray(most, dtype=np.int64)
    most = np.where(votes > 0, most, 0)
    seats = int(min(seats, sum(int(x) for x in np.minimum(most, max(0, seats)))))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)

    def given(d: float):  # quotients votes / (2 k + 1) >= d
        return np.minimum(np.maximum(np.floor((votes / d + 1) / 2), 0), most).astype(np.int64)

    low, high = votes[votes > 0].min() / (4.0 * seats + 4), votes.max() * 2
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low * high) ** 0.5
        if not low < mid < high:
            break
        low, high = (mid, high) if given(mid).sum() >= seats else (low, mid)
    got, over = given(high), given(low)
    rest = seats - int(got.sum())
    extra = np.flatnonzero(over > got)
    cand = sorted((-votes[i] / (2 * k + 1), i) for i in extra.tolist() for k in range(int(got[i]), int(over[i])))
    for _, i in cand[:rest]:
        got[i] += 1
    return got


def source_plan(docs_sized: DataFrame) -> list[dict]:
    """Per source: size and documents, in code point order, null last.  One small row per source."""
    rows = (docs_sized.groupBy("source").agg(F.sum("size").alias("size")).collect())
    return sorted(({"source": r["source"], "size": int(r["size"])} for r in rows),
                  key=lambda r: (r["source"] is None, r["source"] or ""))


def sainte_lague_mix(docs: DataFrame, weights=WEIGHTS, growth: float = GROWTH, most: int = MOST_REPEATS,
                     seed: int = 5, shard_words: int = SHARD_WORDS, row: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    1. Word counts per document, summed per source; targets by weight with the cap ``most``.
    2. The mix is made of blocks of B words each (B = a 400th of the smallest target, 1 to 512):
       Sainte-Lague gives every source its whole number of blocks.
    3. Each source's documents are dealt by a seeded hash into shards of about ``shard_words``
       words (so a hot source has many), and Sainte-Lague splits the source's blocks over its
       shards by their words: an integer quota per shard, at most ``most`` passes.
    4. In a shard the documents stand in seeded order as a ring of words, cut into blocks from a
       seeded start; the quota takes that many blocks round the ring.  A document's share is the
       overlap of its words with the run.

    Returns doc_id, source, size, source_size, target, taken, shard, n_blocks, block_words.
    Nulls: a null text has no words (taken 0); a null source is a source, last in the order; a
    null doc_id is hashed as such.  Repeated rows are separate documents.  Sources without words
    have target 0.  An empty table gives no rows.  Extra columns are not read.  doc_id is taken
    as a key: rows that share one share a shard.  Columns named in ``row`` (a row key) are carried
    through and settle the order of repeated rows.
    """
    import numpy as np

    spark = docs.sparkSession
    tune(spark)
    sized = stored(docs.select("doc_id", "source", *row, F.xxhash64("text").alias("_t"),
                               F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
                               .cast("long").alias("size")), "op5")
    plan = source_plan(sized)
    sizes = [r["size"] for r in plan]
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(plan))], growth, most)
    least = min((g for g in goal if g > 0), default=1.0)
    block = int(max(1, min(512, least // 400)))
    blocks = sainte_lague(goal, round(sum(goal) / block), [most * s // block for s in sizes])
    words = max(shard_words, -(-total // MOST_SHARDS))
    per = [max(1, -(-s // words)) for s in sizes]

    head = spark.createDataFrame(
        [(r["source"], s, float(g), int(p), int(b)) for r, s, g, p, b in zip(plan, sizes, goal, per, blocks, strict=True)],
        "source string, source_size long, target double, _shards long, _blocks long")
    h = F.xxhash64(F.lit(seed), "doc_id")
    # one row per source, null a source of its own; its size is known, so it is sent along while small
    head = F.broadcast(head) if len(plan) <= MOST_BROADCAST else head
    dealt = (sized.join(head.withColumnRenamed("source", "_source"),
                        F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
             .withColumn("_h", h).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.col("_shards"))))

    cells = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("_blocks").alias("_blocks"))

    def split(pdf):
        pdf = pdf.sort_values("shard")
        w = pdf["words"].to_numpy(dtype=np.int64)
        pdf["n_blocks"] = sainte_lague(w, int(pdf["_blocks"].iloc[0]), most * w // block)
        return pdf[["source", "shard", "words", "n_blocks"]]

    quotas = stored(cells.groupBy("source").applyInPandas(
        split, "source string, shard long, words long, n_blocks long"), "op5")
    quotas = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_c"), "words", "n_blocks")

    ring = Window.partitionBy("source", "shard").orderBy("_h", "doc_id", "size", "_t", *row)
    run = (dealt.withColumn("_start", F.sum("size").over(ring.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
           .join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_c"))))
    b, w = F.lit(block).cast("long"), F.col("words")
    first = F.when(w > 0, F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(w, F.lit(1).cast("long"))))
    run = (run.withColumn("_first", F.call_function("div", first, b) * b)
           .withColumn("_len", F.col("n_blocks") * b))
    # words of [start, start + size) on the ring at or before _first + _len, minus those before _first
    end = F.col("_first") + F.col("_len")

    def upto(x):  # how many of the document's words lie in [0, x) of the unrolled ring
        laps, part = F.call_function("div", x, w), F.pmod(x, w)
        return laps * F.col("size") + F.least(F.greatest(part - F.col("_start"), F.lit(0).cast("long")), F.col("size"))

    taken = F.when(w > 0, upto(end) - upto(F.col("_first"))).otherwise(F.lit(0).cast("long"))
    return run.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
                      "shard", "n_blocks", F.lit(block).alias("block_words"), *row)
