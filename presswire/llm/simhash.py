"""SimHash near-duplicates: fingerprints in Gray order under a hierarchical index of shared bits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import components, star_edges, stored, tune, with_row_key

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Children of an index node.
FAN = 16
#: Members of one leading block above which it is dealt out further.
MOST_BLOCK = 8192


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash over the XXH64 of word shingles (A-Z lowered); 0 without words."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle, len(words))
    space = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    begin = np.concatenate([[0], space + 1])[:len(words) - k + 1].tolist()
    end = np.append(space, len(joined))[k - 1:].tolist()
    h = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(begin, end, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_udf(shingle: int = SHINGLE, seed: int = SEED):
    """Arrow-batched column function: text -> fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(np.array([fingerprint(t, shingle, seed) for t in text], dtype=np.uint64).view(np.int64))

    return simhash.asNondeterministic()  # evaluated once


def gray_rank(x):
    """Place of each fingerprint in the reflected Gray sequence: the prefix XOR of its bits."""
    import numpy as np

    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """A hierarchy over fingerprints in Gray order, one tree for each leading block.

    Neighbours in Gray order share bits.  A node keeps, of the bits that all its members share, those its
    parent does not have yet (mask and pattern); going down, a query adds the bits in which it
    differs from each node's own mask, and leaves a whole group once the sum exceeds the limit.
    """

    def __init__(self, prints, block):
        """``prints`` uint64 sorted by (block, Gray rank), ``block`` the leading block of each."""
        import numpy as np

        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        n = len(prints)
        self.prints = prints
        low, high = np.arange(n), np.arange(n) + 1  # members of a node
        both, any_, tree = prints.copy(), prints.copy(), block
        levels = [(low, high, both, any_, tree)]
        while len(low) > len(np.unique(tree)):
            # up to FAN consecutive nodes of one tree become one
            new = np.concatenate([[True], tree[1:] != tree[:-1]])
            first = np.flatnonzero(new)
            nth = np.arange(len(tree)) - np.repeat(first, np.diff(np.append(first, len(tree))))
            at = np.flatnonzero(nth % FAN == 0)
            both = np.bitwise_and.reduceat(both, at)
            any_ = np.bitwise_or.reduceat(any_, at)
            low, high, tree = low[at], high[np.append(at[1:], len(high)) - 1], tree[at]
            levels.append((low, high, both, any_, tree))
        levels.reverse()  # roots first
        self.levels = []
        above = None
        for k, (low, high, both, any_, tree) in enumerate(levels):
            shared = both | (any_ ^ full)
            if above is None:
                mask = shared
            else:
                parent = np.searchsorted(above[0], low, side="right") - 1
                mask = shared & ~above[1][parent]
            if k + 1 < len(levels):
                child = levels[k + 1][0]
                kids = np.searchsorted(child, low), np.searchsorted(child, high)
            else:
                kids = None
            self.levels.append((mask, both & mask, kids))
            above = (low, shared)
        self.root_tree = levels[0][4]

    def within(self, query, block, most: int, step: int = 20_000):
        """Pairs (query number, member number) that differ in at most ``most`` bits, query's tree only."""
        import numpy as np

        for s in range(0, len(query), step):
            q = np.arange(s, min(s + step, len(query)))
            node = np.searchsorted(self.root_tree, block[q])
            inside = node < len(self.root_tree)
            inside[inside] = self.root_tree[node[inside]] == block[q][inside]
            q, node = q[inside], node[inside]
            off = np.zeros(len(q), dtype=np.uint8)
            for mask, pattern, kids in self.levels:
                off = off + np.bitwise_count((query[q] ^ pattern[node]) & mask[node])
                keep = off <= most
                q, node, off = q[keep], node[keep], off[keep]
                if kids is None:
                    break
                n = kids[1][node] - kids[0][node]
                ends = np.cumsum(n)
                inner = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n)
                q, node, off = np.repeat(q, n), np.repeat(kids[0][node], n) + inner, np.repeat(off, n)
            yield q, node


def block_widths(most: int) -> list[tuple[int, int]]:
    """(rotation, width) of most + 1 blocks: fingerprints within ``most`` bits agree in one block at least."""
    n = most + 1
    at = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(at[:-1], at[1:], strict=True)]


def _spread(mask_bits: int, most: int) -> list[int]:
    """All words of ``mask_bits`` bits with 1 to ``most`` ones."""
    from itertools import combinations

    return [sum(1 << i for i in c) for k in range(1, most + 1) for c in combinations(range(mask_bits), k)]


def near_prints(prints: DataFrame, most: int = MAX_BITS, most_block: int = MOST_BLOCK) -> DataFrame:
    """A star forest (a, b) of the links between distinct fingerprints (column fp, signed long).

    Each of most + 1 rotations brings another block of bits to the front; fingerprints that link agree in
    at least one leading block, so (rotation, block) keys send linked pairs to one task.  A block with more
    than ``most_block`` members is dealt out by its next bits; a fingerprint then also visits the
    parts that differ from its own in up to ``most`` of them.  Each task sorts its members in Gray order,
    searches them in the index and sends on a spanning forest of the links it finds.
    """
    widths = block_widths(most)

    def rotated(rot: int):
        return F.col("fp") if not rot else F.shiftleft("fp", rot).bitwiseOR(F.shiftrightunsigned("fp", 64 - rot))

    rows = prints.select("fp", F.explode(F.array(*[F.struct(
        F.lit(i).alias("rot"), F.shiftrightunsigned(rotated(rot), 64 - width).alias("block"),
        rotated(rot).alias("turned")) for i, (rot, width) in enumerate(widths)])).alias("k")).select("fp", "k.*")
    large = (rows.groupBy("rot", "block").agg(F.count("*").alias("n")).where(F.col("n") > most_block)
             .select("rot", "block", F.least(F.ceil(F.log2(F.col("n") / most_block)) + 1, F.lit(16)).cast("int").alias("depth")))
    rows = rows.join(large, ["rot", "block"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    width = F.element_at(F.array(*[F.lit(w) for _, w in widths]), F.col("rot") + 1)
    # the next ``depth`` bits behind the block
    part = F.when(F.col("depth") > 0, F.call_function(
        "shiftrightunsigned", F.call_function("shiftleft", F.col("turned"), width), 64 - F.col("depth"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("part", part)
    visits = F.filter(F.array(*[F.lit(v).cast("long") for v in _spread(16, most)]),
                      lambda v: (v < F.call_function("shiftleft", F.lit(1).cast("long"), F.col("depth")))
                      & (F.col("part").bitwiseXOR(v) > F.col("part")))
    home = rows.select("rot", "block", "part", "fp", F.lit(True).alias("home"))
    away = (rows.where("depth > 0").select("rot", "block", "fp", "part", F.explode(visits).alias("v"))
            .select("rot", "block", F.col("part").bitwiseXOR(F.col("v")).alias("part"), "fp", F.lit(False).alias("home")))
    dealt = home.unionByName(away)
    n_parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n_parts, "rot", "block", "part").sortWithinPartitions("rot", "block", "part")

    def links(frames):
        import numpy as np

        def search(pdf):
            # one tree for each (rot, block, part)
            key = pdf[["rot", "block", "part"]].to_numpy()
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            tree = np.cumsum(new) - 1
            alone = np.bincount(tree) < 2
            pick = ~alone[tree]
            tree, fp = tree[pick], pdf["fp"].to_numpy()[pick].view(np.uint64)
            home_ = pdf["home"].to_numpy()[pick]
            if not len(fp):
                return
            m_tree, m_fp = tree[home_], fp[home_]
            order = np.lexsort((gray_rank(m_fp), m_tree))
            m_tree, m_fp = m_tree[order], m_fp[order]
            if not len(m_fp):
                return
            index = GrayIndex(m_fp, m_tree)
            for q, node in index.within(fp, tree, most):
                a, b = fp[q], m_fp[node]
                keep = a != b
                a, b = star_edges(a[keep].view(np.int64), b[keep].view(np.int64))
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

        rest = None
        for pdf in frames:  # whole groups only: the last one may go on in the next batch
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = pdf.iloc[-1]
            tail = ((pdf["rot"] == last["rot"]) & (pdf["block"] == last["block"]) & (pdf["part"] == last["part"])).to_numpy()
            rest = pdf[tail]
            if not tail.all():
                yield from search(pdf[~tail].reset_index(drop=True))
        if rest is not None and len(rest):
            yield from search(rest.reset_index(drop=True))

    return dealt.mapInPandas(links, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, most: int = MAX_BITS, seed: int = SEED,
                   most_block: int = MOST_BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, fp of every document.

    Equal fingerprints are one node, so copies cost one row; component_id is the smallest doc_id that
    links of at most ``most`` bits reach.  Null, empty and blank texts have fingerprint zero and are
    linked like any other.  Repeated rows share their component.  A null doc_id is ignored in
    the minimum (null only if the whole component has none).  An empty table gives no rows; extra
    columns are not read.
    """
    return _grouped(docs, [], shingle, most, seed, most_block).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def _grouped(docs: DataFrame, row: list[str], shingle: int = SHINGLE, most: int = MAX_BITS, seed: int = SEED,
             most_block: int = MOST_BLOCK) -> DataFrame:
    """doc_id, fp, component_id of every row; with a row key also the key, and the first row of its component
    (by doc_id, null last, then by key)."""
    tune(docs.sparkSession)
    own = stored(docs.select("doc_id", *row, fingerprint_udf(shingle, seed)("text").alias("fp")), "op8")
    lows = {"least": F.col("doc_id")} | {"first": F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", c) for c in row}
    nodes = stored(own.groupBy("fp").agg(*[F.min(c).alias(n) for n, c in lows.items()]), "op8")
    edges = near_prints(nodes.select("fp"), most, most_block)
    comp = components(edges, "op8")
    linked = (comp.join(nodes.withColumnRenamed("fp", "node"), "node"))
    low = linked.groupBy("root").agg(*[F.min(n).alias(f"low_{n}") for n in lows])
    found = linked.join(low, "root").select(F.col("node").alias("fp"), *[f"low_{n}" for n in lows])
    label = nodes.join(found, "fp", "left").select("fp", *[F.coalesce(f"low_{n}", n).alias(n) for n in lows])
    return own.join(label, "fp").withColumnRenamed("least", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each group: that with the smallest doc_id (any of them if rows share it; null only if no row has one).

    Rows are told apart by their place in the stored table, so repeated rows, rows without a doc_id and
    different texts under one doc_id are judged each for itself.
    """
    rows = with_row_key(docs, "op8")
    gone = _grouped(rows, ["_row"], **options).where("_row <> first._row").select("_row")
    return rows.join(gone, "_row", "left_anti").select(docs.columns)
