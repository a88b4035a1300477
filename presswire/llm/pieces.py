"""Sentencepiece encoding that keeps offsets: every piece is projected to the bytes of the text it came from.

A model normalises a text before it cuts it, by a compiled character map: a double-array trie of byte strings
and their replacements, of which the longest that begins at a place is taken.  The map is walked here for
all places of a batch of texts at once, and for every byte of the normalised text the place it
came from is kept.  The model then cuts the normalised text with its own normaliser switched off, and
the pieces, which cover the normalised bytes without a gap, are read back through that record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import tune
from presswire.llm.tokens import batches, vocabulary

MARK = "▁".encode()
ENCODED = "doc_id long, n_tokens long, ids binary, begins binary, ends binary"


class CharacterMap:
    """A model's compiled character map: trie units and the replacements that its leaves point into."""

    def __init__(self, blob: bytes):
        import numpy as np

        n = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=n // 4, offset=4 if blob else 0).astype(np.int64)
        self.out = blob[4 + n:]

    def replacement(self, at: int) -> bytes:
        return self.out[at:self.out.index(b"\0", at)]

    @staticmethod
    def _child(unit):
        """Where the children of a trie unit lie, relative to it."""
        import numpy as np

        return (unit >> 10) << np.where(unit & 512, 8, 0)

    def longest(self, b, starts, stops):
        """For each start in the bytes b: the length of the longest key there that ends by its stop (0: none) and
        the place of its replacement.  All starts go down the trie together; those without a way drop out."""
        import numpy as np

        length, value = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        if not len(self.units):
            return length, value
        live = np.arange(len(starts))
        node = np.full(len(starts), int(self._child(self.units[:1])[0]))
        depth = 0
        while True:
            live_stays = starts[live] + depth < stops[live]
            live, node = live[live_stays], node[live_stays]
            if not len(live):
                return length, value
            byte = b[starts[live] + depth].astype(np.int64)
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            same = (node < len(self.units)) & (unit & 0x800000FF == byte)
            live, node, unit = live[same], node[same], unit[same]
            depth += 1
            node = node ^ self._child(unit)
            leaf = unit >> 8 & 1 > 0
            length[live[leaf]] = depth
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF


class PieceEncoder:
    """Ids and original byte spans of texts under a sentencepiece model file."""

    def __init__(self, path: str | None = None, model: bytes | None = None):
        import numpy as np
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        if model is None:
            with open(path, "rb") as f:
                model = f.read()
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.squeeze = spec.remove_extra_whitespaces
        self.space = MARK if spec.escape_whitespaces else b" "
        spec.precompiled_charsmap = b""
        spec.name = "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.begin_id, self.end_id, self.unknown = self.own.bos_id(), self.own.eos_id(), self.own.unk_id()
        self.width = np.fromiter((1 if p.type == p.BYTE else len(p.piece.encode()) for p in proto.pieces), dtype=np.int64)

    def normalise(self, texts: list[str]):
        """The normalised texts (bytes run together, and edges), and for each of their bytes, one more per text, the place
        in its own text that it came from."""
        import numpy as np

        raws = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        b = np.frombuffer(b"".join(raws), dtype=np.uint8)
        starts = np.flatnonzero(b & 0xC0 != 0x80)  # characters
        text = np.repeat(np.arange(len(texts)), sizes)[starts]
        stops = np.cumsum(sizes)[text]
        length, value = self.map.longest(b, starts, stops)
        size = np.diff(np.append(starts, len(b)))
        # a key of several characters hides the starts inside it; the taken ones are found from left to right
        hidden, reach = np.zeros(len(starts), dtype=bool), 0
        for k in np.flatnonzero(length > size).tolist():
            if starts[k] >= reach:
                reach = int(starts[k] + length[k])
                hidden[k + 1:np.searchsorted(starts, reach)] = True
        kept = ~hidden
        starts, text, length, value = starts[kept], text[kept], length[kept], value[kept]
        taken = np.where(length > 0, length, size[kept])
        # what each chunk becomes: its own bytes, or a replacement
        became, reps, at = taken.copy(), {}, []
        for k in np.flatnonzero(length).tolist():
            v = int(value[k])
            reps.setdefault(v, self.map.replacement(v))
            became[k] = len(reps[v])
            at.append(k)
        chunk = np.repeat(np.arange(len(starts)), became)
        within = np.arange(len(chunk)) - np.repeat(np.cumsum(became) - became, became)
        out = np.zeros(len(chunk), dtype=np.uint8)
        own = length[chunk] == 0
        out[own] = b[starts[chunk[own]] + within[own]]
        out[~own] = np.frombuffer(b"".join(reps[int(value[k])] for k in at), dtype=np.uint8)
        source, who = starts[chunk], text[chunk]
        offset = np.cumsum(sizes) - sizes
        ends = sizes.copy()  # where what follows the last kept byte began
        some = sizes > 0
        if self.squeeze:
            keep, ends, some = self._squeeze(out, chunk, within, who, source, offset, sizes)
            out, source, who = out[keep], source[keep], who[keep]
        # spaces take the mark's three bytes, and each text gets its added space and a last entry of the record
        is_space = out == 32
        wide = np.where(is_space, len(self.space), 1)
        n = np.bincount(who, weights=wide, minlength=len(texts)).astype(np.int64)
        if self.squeeze and not self.suffix:
            some = n > 0
        added = np.where(some, len(self.space) if self.prefix else 0, 0)
        edges = np.concatenate([[0], np.cumsum(n + added)])
        record_edges = edges + np.arange(len(texts) + 1)
        final = np.zeros(int(edges[-1]), dtype=np.uint8)
        record = np.zeros(int(record_edges[-1]), dtype=np.int64)
        lead = np.zeros(len(texts), dtype=np.int64) if self.suffix else added
        first = np.concatenate([[0], np.cumsum(wide)])[:-1]  # place of each byte without the added ones
        place = first + (np.cumsum(added) - added + lead)[who]
        for j in range(len(self.space)):
            final[place[is_space] + j] = self.space[j]
            record[place[is_space] + j + who[is_space]] = source[is_space] - offset[who[is_space]]
        final[place[~is_space]] = out[~is_space]
        record[place[~is_space] + who[~is_space]] = source[~is_space] - offset[who[~is_space]]
        head = np.zeros(len(texts), dtype=np.int64)
        own = np.flatnonzero(n)
        head[own] = (source - offset[who])[np.searchsorted(who, own)]
        for j in range(len(self.space) if self.prefix else 0):
            t = np.flatnonzero(added)
            at_ = edges[t + 1] - added[t] + j if self.suffix else edges[t] + j
            final[at_] = self.space[j]
            record[at_ + t] = ends[t] if self.suffix else head[t]
        record[record_edges[1:] - 1] = ends
        return final, edges, record

    def _squeeze(self, out, chunk, within, who, source, offset, sizes):
        """Which bytes stay when runs of spaces become one and those at either end of a text go, and where each text's
        kept part ends in its source."""
        import numpy as np

        n, space = len(out), out == 32
        new_text = np.diff(who, prepend=-1) > 0
        after = np.concatenate([[True], space[:-1]]) | new_text  # a space or nothing before this byte
        begins = within == 0
        # a chunk's leading spaces go where the chunk follows a space
        run = np.maximum.accumulate(np.where(~space | (begins & ~after), np.arange(n), -1))
        chunk_first = np.arange(n) - within
        lead = space & (run < chunk_first)  # only spaces before it in its chunk, and the chunk follows a space
        keep = ~lead
        # spaces left at the end of a text
        text_last = np.zeros(len(sizes), dtype=np.int64) - 1
        blank = space.copy()
        if n > 2 and self.space == MARK:
            # a mark that stands in the text itself goes there too
            mark = np.flatnonzero((out[:-2] == MARK[0]) & (out[1:-1] == MARK[1]) & (out[2:] == MARK[2]))
            blank[(mark[:, None] + np.arange(3)).ravel()] = True
        solid = np.flatnonzero(keep & ~blank)
        text_last[who[solid]] = solid
        trail = keep & (np.arange(n) > text_last[who])
        ends = sizes.copy()
        where = np.flatnonzero(trail)[::-1]
        ends[who[where]] = source[where] - offset[who[where]]
        # a text of marks alone keeps nothing, but a space added behind it stays
        return keep & ~trail, ends, np.bincount(who[keep], minlength=len(sizes)) > 0

    def encode(self, texts: list[str]):
        """Per text, all run together: ids with the begin and end id, first byte and end byte in the text; ids of each."""
        import numpy as np

        final, edges, record = self.normalise(texts)
        raw, cut = final.tobytes(), edges.tolist()
        plain = [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        lists = self.bare.encode(plain, num_threads=1, return_type="numpy")
        count = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *lists])
        width = self.width[ids]
        if (ids == self.unknown).any():
            # an unknown piece may be of any length: ask for the surfaces of the texts that hold one
            which = np.unique(np.repeat(np.arange(len(texts)), count)[ids == self.unknown]).tolist()
            first = np.cumsum(count) - count
            for k in which:
                got = [p.end - p.begin for p in self.bare.encode(plain[k], return_type="proto").pieces]
                width[first[k]:first[k] + count[k]] = got
        text = np.repeat(np.arange(len(texts)), count)
        stop = np.cumsum(width)
        begins, ends = record[stop - width + text], record[stop + text]
        # the begin id in front of a text covers nothing, as does the end id behind it
        first = np.cumsum(count) - count
        sizes = np.fromiter((len(t.encode()) for t in texts), dtype=np.int64, count=len(texts))
        slots = np.concatenate([first, first + count])
        order = np.concatenate([np.arange(len(texts)) * 2, np.arange(len(texts)) * 2 + 1])
        slots = slots[np.argsort(order, kind="stable")]
        put = lambda x, a, b: np.insert(x, slots, np.stack([a, b], axis=1).ravel())
        none = np.zeros(len(texts), dtype=np.int64)
        return (put(ids, none + self.begin_id, none + self.end_id), put(begins, none, sizes), put(ends, none, sizes), count + 2)


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this model file, built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Piece ids of every document of ``docs`` (doc_id, text) with the begin and end id, and the bytes they came from.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), begins and ends (little-endian unsigned
    64-bit integers: byte offsets in the UTF-8 text of each id; see ``unpacked``).  Pieces made of one byte of a
    longer character have that character's start, the last of them its end.

    A null text is read as empty and holds the begin and end id alone; every row counts for itself, also repeated
    or with a null doc_id; very long texts are encoded whole.  An empty table gives no rows; other columns are not read.
    """
    tune(docs.sparkSession)
    path = path or vocabulary("piece_bpe_32k.model")

    def rows(frames):
        import numpy as np
        import pandas as pd

        tool = piece_encoder(path)
        for pdf in frames:
            for at, texts in batches(pdf["text"].tolist(), 1 << 18):
                ids, begins, ends, count = tool.encode(texts)
                edge = np.concatenate([[0], np.cumsum(count)]).tolist()
                cut = lambda x, kind: [x[a:b].tobytes() for x in (x.astype(kind),)
                                       for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at:at + len(texts)].astype("Int64").to_numpy(dtype=object, na_value=None),
                                    "n_tokens": count, "ids": cut(ids, "<u4"), "begins": cut(begins, "<u8"),
                                    "ends": cut(ends, "<u8")}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, ENCODED)


def unpacked(blob: bytes, kind: str = "<u4") -> list[int]:
    import numpy as np

    return np.frombuffer(blob, dtype=kind).tolist()


def decode_pieces(encoded: DataFrame, path: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a column ``out``: the text that the model's decode() gives for each row's ``ids``.

    Null ids give a null text.
    """
    path = path or vocabulary("piece_bpe_32k.model")

    @F.pandas_udf("string")
    def back(column):
        import numpy as np
        import pandas as pd

        tool = piece_encoder(path).own
        lists = [None if x is None else np.frombuffer(x, dtype="<u4").tolist() for x in column]
        return pd.Series([None if x is None else tool.decode(x) for x in lists], dtype=object)

    return encoded.withColumn(out, back(F.col(ids)))
