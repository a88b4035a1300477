"""Token ids in directly addressable codes: random access to any token without decoding a block.

An id is split into 8-bit chunks, lowest first.  Level k holds the k-th chunk of every id that has one,
and a bitmap that says for each whether a further chunk follows; a rank directory counts the ones
before each 512-bit stretch.  Entry i continues in the next level at rank(i).
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswire.llm.common import checkpoint_dir, tune
from presswire.llm.tokens import batches, encoder, vocabulary

MAGIC = b"DAC1"
CHUNK = 8
STRETCH = 512
#: Ids after which a file row is closed: a reader needs one row in memory.
ROW_IDS = 1 << 20
END = 0

LAYOUT = "part long, seq long, n_docs long, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"


def encode(ids) -> bytes:
    """A DAC of unsigned 32-bit ids: header, then per level its chunks, bitmap and rank directory."""
    import numpy as np

    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while len(rest) or not levels:
        more = rest >> CHUNK > 0
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (STRETCH // 8), dtype=np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, STRETCH // 8).sum(axis=1, dtype=np.uint32)
        rank = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4") if len(ones) else np.zeros(0, dtype="<u4")
        levels.append(((rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        rest = rest[more] >> CHUNK
        if not len(rest):
            break
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(
        struct.pack("<QQQ", *map(len, level)) for level in levels)
    return head + b"".join(x for level in levels for x in level)


class Dac:
    """Reads a DAC: ``all()`` or any positions by ``at``."""

    def __init__(self, blob: bytes):
        import numpy as np

        if blob[:4] != MAGIC:
            raise ValueError("not a DAC")
        n_levels = struct.unpack_from("<I", blob, 4)[0]
        sizes = [struct.unpack_from("<QQQ", blob, 8 + 24 * k) for k in range(n_levels)]
        self.levels, at = [], 8 + 24 * n_levels
        for size in sizes:
            level = []
            for n, kind in zip(size, (np.uint8, np.uint8, "<u4"), strict=True):
                level.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at))
                at += n
            self.levels.append(level)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, positions):
        """The ids at ``positions``: each level is entered only for the ids that reach it."""
        import numpy as np

        pos = np.asarray(positions, dtype=np.int64)
        if len(pos) and not (0 <= pos.min() and pos.max() < len(self)):
            raise IndexError("no such token")
        out, who = np.zeros(len(pos), dtype=np.uint32), np.arange(len(pos))
        for k, (chunks, bits, rank) in enumerate(self.levels):
            out[who] |= chunks[pos].astype(np.uint32) << np.uint32(CHUNK * k)
            more = (bits[pos >> 3] >> (pos & 7).astype(np.uint8)) & 1 > 0
            pos, who = pos[more], who[more]
            if not len(pos):
                break
            # ones before pos: directory, whole bytes of the stretch, bits of its last byte
            stretch = pos // STRETCH
            byte = np.arange(STRETCH // 8)
            whole = bits.reshape(-1, STRETCH // 8)[stretch]
            before = np.where(byte < ((pos % STRETCH) >> 3)[:, None], np.bitwise_count(whole), 0).sum(axis=1)
            last = bits[pos >> 3] & ((1 << (pos & 7)) - 1).astype(np.uint8)
            pos = rank[stretch] + before + np.bitwise_count(last)
        return out

    def all(self):
        import numpy as np

        out = self.levels[0][0].astype(np.uint32)
        where = None
        for k, (chunks, bits, _) in enumerate(self.levels):
            n = len(chunks)
            if k:
                out[where] |= chunks.astype(np.uint32) << np.uint32(CHUNK * k)
            more = np.unpackbits(bits, count=n, bitorder="little") > 0 if n else np.zeros(0, dtype=bool)
            where = np.flatnonzero(more) if where is None else where[more]
        return out


def write_dac(docs: DataFrame, path: str, vocab: str | None = None, end: int = END, row_ids: int = ROW_IDS) -> None:
    """Write the token ids of ``docs`` in ascending doc_id order as a data set of DAC rows at ``path``.

    Documents are dealt by ranges of doc_id and sorted in their range; each task encodes its range and
    closes a row (document ids, lengths, DAC) after about ``row_ids`` ids.  Spark's writer commits
    whole tasks, so a lost executor leaves no half file.  The order is that of (part, seq).
    """
    spark = docs.sparkSession
    tune(spark)
    vocab = vocab or vocabulary()

    def rows(frames):
        import numpy as np
        import pandas as pd

        part, seq, ids, docs_, lens, size = None, 0, [], [], [], 0

        def row():
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(docs_)], "n_ids": [len(flat)],
                                 "doc_ids": [docs_], "lengths": [lens], "codes": [encode(flat)]})

        enc = encoder(vocab)
        for pdf in frames:
            if part is None and len(pdf):
                part = int(pdf["part"].iloc[0])
            keys = pdf["doc_id"].tolist()
            for at, texts in batches(pdf["text"].tolist()):
                flat, counts = enc.encode(texts)
                # the end id goes behind each text's ids
                flat = np.insert(flat, np.cumsum(counts), end).astype(np.uint32)
                edges = np.concatenate([[0], np.cumsum(counts + 1)]).tolist()
                for j in range(len(texts)):
                    ids.append(flat[edges[j]:edges[j + 1]])
                    k = keys[at + j]
                    docs_.append(None if pd.isna(k) else int(k))
                    lens.append(edges[j + 1] - edges[j])
                    size += lens[-1]
                    if size >= row_ids:
                        yield row()
                        seq, ids, docs_, lens, size = seq + 1, [], [], [], 0
        if docs_:
            yield row()

    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange(n_parts, "doc_id").sortWithinPartitions("doc_id", "text")
     .select(F.spark_partition_id().cast("long").alias("part"),
             "doc_id", "text")
     .mapInPandas(rows, LAYOUT).write.parquet(path))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Rows (part, seq, n_ids, row_start): where each DAC row begins in the whole id sequence.

    Starts are summed within a part (in parallel) and over the parts (one small row each).
    """
    rows = spark.read.parquet(path).select("part", "seq", "n_ids")
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return (rows.withColumn("own", F.coalesce(F.sum("n_ids").over(own), F.lit(0))).join(before, "part")
            .select("part", "seq", "n_ids", (F.col("base") + F.col("own")).cast("long").alias("row_start")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written codes alone."""

    def back(frames):
        import zlib

        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
            for docs_, lens, codes, start in zip(pdf["doc_ids"], pdf["lengths"], pdf["codes"], pdf["row_start"],
                                                 strict=True):
                raw = memoryview(Dac(codes).all().astype("<u4").tobytes())
                edges = np.concatenate([[0], np.cumsum(np.asarray(lens, dtype=np.int64))])
                out["doc_id"] += [None if d is None or d != d else int(d) for d in docs_]
                out["start"] += (edges[:-1] + int(start)).tolist()
                out["n_tokens"] += np.diff(edges).tolist()
                out["ids_crc32"] += [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    rows = spark.read.parquet(path).drop("n_ids", "n_docs").join(directory(spark, path), ["part", "seq"])
    return rows.select("doc_ids", "lengths", "codes", "row_start").mapInPandas(
        back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """The ids at global ``positions`` (a column ``position``): rows (position, id).

    A position is matched to its DAC row by a range join on the directory, then read by rank.
    """
    where = directory(spark, path)
    hit = positions.select(F.col("position").cast("long").alias("position")).join(
        where, F.expr("position >= row_start AND position < row_start + n_ids"))
    asked = hit.groupBy("part", "seq").agg(F.collect_set(F.col("position")).alias("asked"), F.first("row_start").alias("row_start"))

    def read(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            for asked_, start, codes in zip(pdf["asked"], pdf["row_start"], pdf["codes"], strict=True):
                p = np.sort(np.asarray(asked_, dtype=np.int64))
                yield pd.DataFrame({"position": p, "id": Dac(codes).at(p - int(start)).astype(np.int64)})

    rows = spark.read.parquet(path).select("part", "seq", "codes").join(asked, ["part", "seq"])
    return rows.select("asked", "row_start", "codes").mapInPandas(read, "position long, id long")


def dac_tokens(docs: DataFrame, vocab: str | None = None, end: int = END) -> DataFrame:
    """Encode, write in the file format, read back: one row per document, from the files.

    Null and empty texts hold the end id alone; a null doc_id comes first; repeated rows each keep a
    place, ties in doc_id go by text.  An empty table gives no rows; extra columns are not read.
    """
    import uuid

    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/dac-{uuid.uuid4().hex}"
    write_dac(docs, path, vocab, end)
    return read_documents(spark, path)
