"""Packing by cutting-stock column generation: a linear program over length-histogram patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswire.llm.common import stored, tune
from presswire.llm.tokens import batches, encoder, vocabulary

MAX_TOKENS = 2048
END = 1
#: The program stops when its value is this close to a proven lower bound.
GAP = 0.004
#: A bin of lengths is at most this share wide, so a piece wastes at most that when placed.
BIN_SHARE = 1 / 64
#: Rows of one numbering chunk.
CHUNK_ROWS = 20_000


def length_bins(limit: int, share: float = BIN_SHARE):
    """Upper ends of the length bins 1..limit: single lengths while short, then about ``share`` wide."""
    import numpy as np

    ends, at = [], 0
    while at < limit:
        at = min(limit, at + max(1, int(at * share)))
        ends.append(at)
    return np.array(ends, dtype=np.int64)


def best_pattern(sizes, values, limit: int):
    """Unbounded knapsack: counts of each size with the most value within ``limit`` (dynamic program)."""
    import numpy as np

    best = np.zeros(limit + 1)
    pick = np.full(limit + 1, -1, dtype=np.int64)
    fits = np.searchsorted(sizes, np.arange(limit + 1), side="right").tolist()  # sizes ascend
    for c in range(1, limit + 1):
        n = fits[c]
        best[c], pick[c] = best[c - 1], -1
        if n:
            got = best[c - sizes[:n]] + values[:n]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], i
    counts, c = np.zeros(len(sizes), dtype=np.int64), limit
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[limit]), counts


def first_patterns(sizes, demand, limit: int):
    """Patterns that fill greedily from the longest piece left, and how often each is used; covers the demand."""
    import numpy as np

    left, out = demand.astype(np.int64).copy(), []
    top = len(sizes) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return out
        counts, room = np.zeros(len(sizes), dtype=np.int64), limit
        i = top
        while i >= 0 and room >= sizes[0]:
            i = min(i, int(np.searchsorted(sizes, room, side="right")) - 1)
            if i < 0:
                break
            k = min(int(left[i] - counts[i]), room // int(sizes[i]))
            if k > 0:
                counts[i] += k
                room -= k * int(sizes[i])
            i -= 1
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left -= times * counts
        out.append((counts, times))


def solve_patterns(sizes, demand, limit: int, gap: float = GAP, most_rounds: int = 2000):
    """Column generation for: fewest sequences so that the patterns hold every piece.

    Revised simplex on the restricted master (one row per bin in use); the knapsack program prices
    columns.  Stops when no column improves or the value is within ``gap`` of a lower bound: the
    pieces' total length / limit, or Farley's value / price.  Returns (patterns, uses): whole uses, rounded down.
    """
    import numpy as np

    m = len(sizes)
    # a feasible basis: every bin alone, as often as it fits
    basis = [np.eye(m, dtype=np.int64)[i] * (limit // int(sizes[i])) for i in range(m)]
    cols = np.stack(basis, axis=1).astype(np.float64)
    inverse = np.diag(1 / np.diag(cols))
    x = inverse @ demand
    pool = [p for p, _ in first_patterns(sizes, demand, limit)]
    area = float(sizes @ demand) / limit
    for turn in range(most_rounds):
        if x.sum() <= area * (1 + gap):
            break
        price = inverse.sum(axis=0)  # cost of every pattern is 1
        column = None
        if pool:
            worth = np.array([p @ price for p in pool])
            i = int(worth.argmax())
            if worth[i] > 1 + 1e-7:
                column = pool[i]
        if column is None:
            value, column = best_pattern(sizes, np.maximum(price, 0), limit)
            if value <= 1 + 1e-7 or x.sum() <= (x.sum() / value) * (1 + gap):
                break
        move = inverse @ column
        ratio = np.where(move > 1e-7, x / np.where(move > 1e-7, move, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        # among equal ratios the largest pivot: stable, and no cycling between tiny ones
        out = int(np.where(ratio <= ratio.min() * (1 + 1e-9) + 1e-12, move, 0).argmax())
        basis[out] = column
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        x = np.maximum(inverse @ demand, 0)
        if turn % 100 == 99:  # against drift
            fresh = np.stack(basis, axis=1).astype(np.float64)
            if np.linalg.cond(fresh) < 1e12:
                inverse = np.linalg.inv(fresh)
                x = np.maximum(inverse @ demand, 0)
    return np.stack(basis), np.floor(x + 1e-9).astype(np.int64)


def plan_sequences(hist, limit: int = MAX_TOKENS, share: float = BIN_SHARE):
    """hist: pieces by length, 0..limit-1.  Patterns (rows: pieces of each bin) and whole uses that hold exactly all.

    Bins group the lengths; the program's uses are rounded down, surplus places are taken out of the
    last uses, and what is left over (fewer pieces than patterns have places) is filled greedily.
    """
    import numpy as np

    ends = length_bins(limit, share)
    of = np.searchsorted(ends, np.arange(len(hist)))
    demand = np.bincount(of, weights=np.asarray(hist, dtype=np.float64), minlength=len(ends)).astype(np.int64)
    used = np.flatnonzero(demand)
    if not len(used):
        return ends, np.zeros((0, len(ends)), dtype=np.int64), np.zeros(0, dtype=np.int64)
    sizes, need = ends[used], demand[used]
    patterns, uses = solve_patterns(sizes, need, limit)
    placed, rows, times = np.zeros(len(used), dtype=np.int64), [], []
    for p, n in zip(patterns, uses.tolist(), strict=True):
        inside = p > 0
        n = min(n, int(((need - placed)[inside] // p[inside]).min()))
        if n > 0:
            rows.append(p)
            times.append(n)
            placed += n * p
    for p, n in first_patterns(sizes, need - placed, limit):
        rows.append(p)
        times.append(n)
    out = np.zeros((len(rows), len(ends)), dtype=np.int64)
    out[:, used] = np.stack(rows)
    return ends, out, np.array(times, dtype=np.int64)


def places(patterns, uses, first_sequence: int):
    """For every bin the runs of ranks: (first rank, pattern's first sequence, pieces per sequence, uses, order)."""
    import numpy as np

    start = first_sequence + np.cumsum(uses) - uses
    table = {}
    for b in np.flatnonzero(patterns.any(axis=0)).tolist():
        rows = np.flatnonzero(patterns[:, b])
        per, n = patterns[rows, b], uses[rows]
        table[b] = (np.cumsum(per * n) - per * n, start[rows], per)
    return table


def pack_sequences(docs: DataFrame, limit: int = MAX_TOKENS, vocab: str | None = None, end: int = END,
                   ids: bool = False) -> DataFrame:
    """Cut the token ids of all documents into pieces and place them in sequences of at most ``limit`` ids.

    1. Every document is encoded and ended with ``end``; whole stretches of ``limit`` ids are sequences
       of their own, the rest is one piece.
    2. The histogram of the rests (``limit`` numbers, whatever the input's size) goes to the driver,
       where column generation finds patterns; uses are rounded to whole sequences.
    3. The rests of a length bin are ranked (by document, gapless, numbered in chunks), and rank k
       takes the k-th place of that bin.  Offsets are summed within a sequence.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and with ``ids`` the ids as
    little-endian bytes).  A null text is empty: its piece is the end id alone.  A null doc_id and repeated
    rows are documents like others; an empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    vocab = vocab or vocabulary()

    def pieces(frames):
        import zlib

        import numpy as np
        import pandas as pd

        enc = encoder(vocab)
        for pdf in frames:
            keys = pdf["doc_id"]
            for at, texts in batches(pdf["text"].tolist()):
                flat, counts = enc.encode(texts)
                flat = np.insert(flat, np.cumsum(counts), end).astype("<u4")
                counts = counts + 1
                n = -(-counts // limit)  # pieces of each document
                doc = np.repeat(np.arange(len(texts)), n)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                begin = nth * limit
                length = np.minimum(counts[doc] - begin, limit)
                base = (np.cumsum(counts) - counts)[doc] + begin
                raw = memoryview(flat.tobytes())
                cut = [raw[4 * s:4 * (s + k)] for s, k in zip(base.tolist(), length.tolist(), strict=True)]
                out = pd.DataFrame({"doc_id": keys.iloc[at:at + len(texts)].to_numpy()[doc], "start": begin,
                                    "length": length, "ids_crc32": [zlib.crc32(x) for x in cut],
                                    "doc_tokens": counts[doc]})
                out["doc_id"] = out["doc_id"].astype("Int64")
                if ids:
                    out["ids"] = [bytes(x) for x in cut]
                yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    whole = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        pieces, schema + ", ids binary" * ids).withColumn("pid", F.monotonically_increasing_id()), "op7")
    schema += ", pid long"
    cut = whole.drop("ids")  # places are found without the ids, which join them once
    rests = cut.where(F.col("length") < limit)
    hist = [0] * limit
    for r in rests.groupBy("length").count().collect():  # at most ``limit`` rows
        hist[r["length"]] = r["count"]
    ends, patterns, uses = plan_sequences(hist, limit)
    n_rest_sequences = int(uses.sum())
    table = places(patterns, uses, 0)

    # rank of a rest in its bin: chunks by document hash, counted, then numbered inside the chunk
    n_rests = sum(hist)
    n_chunks = max(1, -(-n_rests // CHUNK_ROWS))
    edges = F.array(*[F.lit(int(x)) for x in ends])
    rests = rests.withColumn("bin", F.size(F.filter(edges, lambda e: e < F.col("length")))).withColumn(
        "chunk", F.pmod(F.xxhash64("doc_id", "doc_tokens", "ids_crc32"), F.lit(n_chunks)))
    counted = rests.groupBy("bin", "chunk").agg(F.count("*").alias("n"))
    before = counted.select("bin", "chunk", F.coalesce(F.sum("n").over(
        Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("before"))
    own = Window.partitionBy("chunk", "bin").orderBy("doc_id", "ids_crc32", "doc_tokens")
    ranked = (rests.withColumn("own", F.row_number().over(own) - 1).join(before, ["chunk", "bin"])
              .withColumn("rank", F.col("before") + F.col("own")).drop("before", "own", "chunk"))

    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid"]

    def place(frames):
        import numpy as np

        for pdf in frames:
            b, rank = pdf["bin"].to_numpy(), pdf["rank"].to_numpy()
            seq = np.zeros(len(pdf), dtype=np.int64)
            for k in np.unique(b).tolist():
                mine = b == k
                firsts, start, per = table[k]
                run = np.searchsorted(firsts, rank[mine], side="right") - 1
                seq[mine] = start[run] + (rank[mine] - firsts[run]) // per[run]
            pdf["sequence_id"] = seq
            yield pdf[[*keep, "sequence_id"]]

    placed = ranked.mapInPandas(place, f"{schema}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "ids_crc32", "doc_tokens")
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(
        inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    # whole stretches: sequences behind the packed ones, numbered by the partition they lie in
    full = cut.where(F.col("length") == limit)
    full = full.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_chunks)))
    sizes = full.groupBy("chunk").agg(F.count("*").alias("n"))
    before = sizes.select("chunk", F.coalesce(F.sum("n").over(
        Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    each = Window.partitionBy("chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    full = (full.withColumn("own", F.row_number().over(each) - 1).join(before, "chunk")
            .withColumn("sequence_id", F.col("before") + F.col("own") + F.lit(n_rest_sequences))
            .withColumn("offset", F.lit(0).cast("long")).drop("before", "own", "chunk"))
    columns = [*keep, "sequence_id", "offset"]
    every = placed.select(columns).union(full.select(columns))
    return (every.join(whole.select("pid", "ids"), "pid") if ids else every).drop("pid")
