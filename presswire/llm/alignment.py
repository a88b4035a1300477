"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a document.

Both tokenizers cut the same bytes, so each gives a rising list of token ends.  Merging the two lists finds
the ends they share, and these cut the tokens into groups.  The merge is divided by merge-path
partitioning: on every diagonal (a fixed number of list entries taken so far) a binary search finds how
many come from either list; between two diagonals lies a piece of equal work that is merged without
looking at the others, however long one document is.  A piece emits the cuts and overlaps it sees; the
groups that reach over its border are stitched from the open ends of the neighbouring pieces.

Corpus-wide counts go through dictionaries of blocks of documents: a block's distinct id pairs are summed
with those of all blocks, and the counts return to the block once per pair, not once per document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswire.llm.common import stored, tune
from presswire.llm.tokens import UnitEncoder, batches, vocabulary

#: List entries (token ends of both lists) of a merge piece.
PIECE = 1 << 14
#: Characters of text after which a block of documents is closed.
BLOCK = 1 << 23
#: Groups with more links than this are counted by their distinct ids on either side.
WIDE = 1 << 12

STORED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
          "at binary, times binary, pairs array<long>, n_docs array<int>")


def diagonals(a, b, work: int = PIECE):
    """Splits (i, j) of the sorted lists a and b, i + j = 0, work, 2 work ...: a[:i] and b[:j] come first in the
    merged order, an entry of a before its equal in b.  All diagonals are searched at once."""
    import numpy as np

    d = np.append(np.arange(0, len(a) + len(b), work, dtype=np.int64), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # a[mid] belongs before the diagonal unless it is larger than the last entry taken from b
        take = np.zeros(len(d), dtype=bool)
        take[open_] = a[mid[open_]] <= b[(d - mid)[open_] - 1]
        low, high = np.where(open_ & take, mid + 1, low), np.where(open_ & ~take, mid, high)
    return low, d - low


def merge_piece(a, b):
    """Common ends of a piece's own entries: how many entries of a and b lie up to and with each."""
    import numpy as np

    if not len(a) or not len(b):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.searchsorted(b, a)
    hit = np.flatnonzero(b[np.minimum(at, len(b) - 1)] == a)
    return hit + 1, at[hit] + 1


def group_sizes(a, b, work: int = PIECE):
    """Tokens of either side in each group, for rising ends a and b whose last entries are equal."""
    import numpy as np

    i, j = diagonals(a, b, work)
    n_a, n_b = [], []
    open_a = open_b = 0  # tokens of the group that the pieces before left open
    for p in range(len(i) - 1):
        x, y = a[i[p]:i[p + 1]], b[j[p]:j[p + 1]]
        if p and i[p] and len(y) and a[i[p] - 1] == y[0]:
            # the border parts two equal ends: the group closes with this piece's first entry of b
            n_a.append([open_a])
            n_b.append([open_b + 1])
            open_a, open_b, y = 0, 0, y[1:]
        ends_x, ends_y = merge_piece(x, y)
        if len(ends_x):
            got_a, got_b = np.diff(ends_x, prepend=0), np.diff(ends_y, prepend=0)
            got_a[0] += open_a
            got_b[0] += open_b
            n_a.append(got_a)
            n_b.append(got_b)
            open_a, open_b = len(x) - int(ends_x[-1]), len(y) - int(ends_y[-1])
        else:
            open_a, open_b = open_a + len(x), open_b + len(y)
    if open_a or open_b:
        raise ValueError("the lists end at different bytes")
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return join(n_a), join(n_b)


def ranges(starts, counts):
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    import numpy as np

    total = int(counts.sum())
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def link_pairs(ids_a, ids_b, n_a, n_b, doc, n_pairs_b: int):
    """Distinct (document, pair) of all links and how many links each has.

    ``doc`` is the document of each group; a pair is id_a * n_pairs_b + id_b.  A wide group is counted by its
    distinct ids, whose numbers multiply, so that its links are never written out.
    """
    import numpy as np

    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    thin = n_a * n_b <= WIDE
    per_a = np.repeat(np.where(thin, n_b, 0), n_a)  # links of each token of a
    x = np.repeat(ids_a.astype(np.int64), per_a)
    y = ids_b[ranges(np.repeat(first_b, n_a), per_a)].astype(np.int64)
    who = np.repeat(np.repeat(doc, n_a), per_a)
    keys, times = np.unique((who << 32) | (x * n_pairs_b + y), return_counts=True)
    if thin.all():
        return keys, times
    more, much = [keys], [times.astype(np.int64)]
    for g in np.flatnonzero(~thin).tolist():
        u, k = np.unique(ids_a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        v, m = np.unique(ids_b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        more.append(((int(doc[g]) << 32) | (u.astype(np.int64)[:, None] * n_pairs_b + v.astype(np.int64))).ravel())
        much.append((k[:, None] * m).ravel())
    keys, back = np.unique(np.concatenate(more), return_inverse=True)
    times = np.zeros(len(keys), dtype=np.int64)
    np.add.at(times, back, np.concatenate(much))
    return keys, times


class Spellings:
    """Bytes, byte lengths and printed ids of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        import numpy as np

        self.bytes = np.array([*tokens, None], dtype=object)[:-1]
        self.length = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.printed = {mark: np.array([*(f"{i}{mark}" for i in range(len(tokens))), None], dtype=object)[:-1] for mark in ",|;"}


@dataclass
class Side:
    ids: object
    counts: object
    spell: Spellings

    def spells(self, k: int, edges, raw: bytes) -> bool:
        return b"".join(self.spell.bytes[self.ids[edges[k]:edges[k + 1]]]) == raw


class Aligner:
    """Token groups of texts under a byte-level BPE file (a) and a sentencepiece model (b)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = UnitEncoder(path_a)
        self.a.tok.encode_special_tokens = True  # their strings in a text are plain text
        byte = {c: b for b, c in self.a.spell.items()}
        tok, special = self.a.tok, self.a.tok.get_added_tokens_decoder()
        names = (tok.id_to_token(i) for i in range(tok.get_vocab_size()))
        self.spell_a = Spellings([n.encode() if i in special else bytes(byte[c] for c in n) for i, n in enumerate(names)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.n_b = self.b.get_piece_size()
        if tok.get_vocab_size() * self.n_b > 1 << 32:
            raise ValueError("a pair of ids must fit in 32 bits")
        self.spell_b = Spellings([
            bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.n_b)])

    def align(self, texts: list[str]):
        """Per text: n_a, n_b, n_groups, n_links, printed groups; and its distinct pairs with their numbers of links."""
        import numpy as np

        raws = [(" " + t).encode() for t in texts]
        flat, counts = self.a.encode([" " + t for t in texts])
        a = Side(flat, counts, self.spell_a)
        lists = self.b.encode(texts, num_threads=1, return_type="numpy")
        b = Side(np.concatenate([np.zeros(0, dtype=np.int64), *lists]),
                 np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)), self.spell_b)
        edge_a = np.concatenate([[0], np.cumsum(a.counts)])
        edge_b = np.concatenate([[0], np.cumsum(b.counts)])
        good = np.fromiter((bool(t) and a.spells(k, edge_a, r) and b.spells(k, edge_b, r)
                            for k, (t, r) in enumerate(zip(texts, raws, strict=True))), dtype=bool, count=len(texts))
        ids_a, ids_b = a.ids[np.repeat(good, a.counts)].astype(np.int64), b.ids[np.repeat(good, b.counts)]
        n_a, n_b = np.where(good, a.counts, 0), np.where(good, b.counts, 0)
        # ends in the joined bytes of all good texts: a text's last end is common, so no group crosses texts
        size_a, size_b = group_sizes(np.cumsum(self.spell_a.length[ids_a]), np.cumsum(self.spell_b.length[ids_b]))
        doc = np.repeat(np.arange(len(texts)), n_a)[np.cumsum(size_a) - 1]
        n_groups = np.bincount(doc, minlength=len(texts))
        n_links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(n_links, doc, size_a * size_b)
        keys, times = link_pairs(ids_a, ids_b, size_a, size_b, doc, self.n_b)
        return n_a, n_b, n_groups, n_links, self.printed(ids_a, ids_b, size_a, size_b, n_a, n_b), keys, times

    def printed(self, ids_a, ids_b, size_a, size_b, n_a, n_b) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every text."""
        import numpy as np

        words = np.empty(len(ids_a) + len(ids_b), dtype=object)
        before_a = np.cumsum(size_a) - size_a
        before_b = np.cumsum(size_b) - size_b
        for spell, ids, size, place, mark in (
                (self.spell_a, ids_a, size_a, np.repeat(before_b, size_a), "|"),
                (self.spell_b, ids_b, size_b, np.repeat(before_a + size_a, size_b), ";")):
            text = spell.printed[","][ids]
            last = np.cumsum(size) - 1
            text[last] = spell.printed[mark][ids[last]]
            words[place + np.arange(len(ids))] = text
        edges = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        return ["".join(words[x:y])[:-1] for x, y in zip(edges[:-1], edges[1:], strict=True)]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker's aligner of these two files, built once."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _blocks(path_a: str, path_b: str, with_groups: bool):
    """Texts to rows of STORED: one per document, its pairs as places in the block's dictionary, and one per block."""

    def rows(frames):
        import hashlib

        import numpy as np
        import pandas as pd

        names = [c.split()[0] for c in STORED.split(", ")]
        tool, part, n_blocks, docs, size = aligner(path_a, path_b), 0, 0, [], 0

        def close():
            pairs, n_docs = np.unique(np.concatenate([d["pairs"] for d in docs]), return_counts=True)
            block = (part << 32) + n_blocks
            for d in docs:
                d["block"], d["times"] = block, pack(d["times"])
                d["at"] = pack(np.diff(np.searchsorted(pairs, d.pop("pairs")), prepend=0))
            dictionary = {"block": block, "pairs": pairs, "n_docs": n_docs.astype(np.int32)}
            return pd.DataFrame({n: [r.get(n) for r in (*docs, dictionary)] for n in names}).astype(
                {n: "Int64" for n in names[1:6]})

        for pdf in frames:
            if len(pdf):
                part = int(pdf["part"].iloc[0])
            keys = pdf["doc_id"].tolist()
            for first, texts in batches(pdf["text"].tolist(), 1 << 20):
                n_a, n_b, n_groups, n_links, printed, pairs, times = tool.align(texts)
                edge = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1)).tolist()
                pairs &= (1 << 32) - 1
                for k, groups in enumerate(printed):
                    key = keys[first + k]
                    own = slice(edge[k], edge[k + 1])
                    docs.append({
                        "doc_id": None if pd.isna(key) else int(key), "n_a": int(n_a[k]), "n_b": int(n_b[k]),
                        "n_groups": int(n_groups[k]), "n_links": int(n_links[k]), "pairs": pairs[own], "times": times[own],
                        "groups_sha256": hashlib.sha256(groups.encode()).hexdigest() if groups else "",
                        "groups": groups if with_groups else None})
                    size += len(texts[k]) + 1
                if size >= BLOCK:
                    yield close()
                    n_blocks, docs, size = n_blocks + 1, [], 0
        if docs:
            yield close()

    return rows


def pack(values) -> bytes:
    """Unsigned integers in the narrowest width that holds them, behind a byte that names it."""
    import numpy as np

    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(np.dtype(f"<u{width}")).tobytes()


def unpack(blob: bytes):
    import numpy as np

    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


def _counted(docs, dictionary):
    """The documents of a block with n_best and count_sum, from the corpus-wide counts of the block's pairs."""
    import numpy as np

    d = dictionary.sort_values("pair")
    count, best = d["count"].to_numpy(dtype=np.int64), d["best"].to_numpy(dtype=bool)
    n_best, count_sum = [], []
    for at, times in zip(docs["at"], docs["times"], strict=True):
        place, links = np.cumsum(unpack(at)), unpack(times)
        n_best.append(int(links[best[place]].sum()))
        count_sum.append(int((links * count[place]).sum()))
    return docs.drop(columns=["block", "at", "times"]).assign(n_best=n_best, count_sum=count_sum)


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """Token groups and links of every document of ``docs`` (doc_id, text) under two tokenizers.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and with ``groups`` the groups
    themselves as text `a1,a2|b1;a3|b2,b3`.  ``path_a`` is a byte-level BPE file, read before a space and the text;
    ``path_b`` a sentencepiece model, which adds that space.  An id pair's count is the number of rows that hold it
    linked; n_best counts the links whose pair no other pair of the same A id outnumbers (ties included).

    Null and empty texts and those that either side does not spell back have zeros and ''.  Every row counts for
    itself, also with a null doc_id or repeated; ties in counts are all best; very long texts are merged in pieces of
    equal work, and a group without common ends in between is counted by its distinct ids.  An empty table
    gives no rows; other columns are not read.
    """
    tune(docs.sparkSession)
    path_a, path_b = path_a or vocabulary(), path_b or vocabulary("piece_bpe_32k.model")
    n_b = aligner(path_a, path_b).n_b
    rows = stored(docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
                  .mapInPandas(_blocks(path_a, path_b, groups), STORED), "alignment")
    held = rows.where("pairs IS NOT NULL").select(
        F.col("block").alias("home"), F.explode(F.arrays_zip("pairs", "n_docs")).alias("x")).select(
        "home", F.col("x.pairs").alias("pair"), F.col("x.n_docs").alias("n_docs"))
    # a window holds the pairs of one A id: at most the vocabulary of B
    counts = held.groupBy("pair").agg(F.sum("n_docs").alias("count")).withColumn(
        "best", F.col("count") == F.max("count").over(Window.partitionBy(F.expr(f"pair div {n_b}"))))
    known = held.select("home", "pair").join(counts, "pair")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else [])]
    kinds = ", ".join(f"{c} {'string' if c.startswith('groups') else 'long'}" for c in out)
    return (rows.where("at IS NOT NULL").select("block", "at", "times", *out).groupBy("block")
            .cogroup(known.groupBy("home")).applyInPandas(_counted, f"{kinds}, n_best long, count_sum long"))
