"""Token ids of whole texts by the tokenizers library, with a memory of what texts repeat."""

from __future__ import annotations

#: Units remembered by one Python worker (about 60 bytes each); beyond, the memory starts anew.
MOST_UNITS = 800_000
#: Units longer than this are encoded each time.
LONG = 64

_ENCODERS: dict[str, "UnitEncoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "UnitEncoder":
    """The worker's encoder of this vocabulary file, built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as itself if it is visible, else as the next character from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class UnitEncoder:
    """encode(texts) equals the ids of the byte-level BPE tokenizer, text by text.

    The tokenizer's own splitter takes most of its time, so texts are cut with numpy at places where
    the splitter always cuts: before a space that follows a visible character, around a line feed
    between visible characters, and between a letter and a mark.  The units repeat; each is known by two
    64-bit hashes and its ids are looked up.  A new unit that is one word goes to the library's BPE
    model, any other to its encode().
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import numpy as np
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spell = byte_characters()
        rng = np.random.default_rng(2024)
        self.mix = rng.integers(1, 1 << 63, size=(2, LONG), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        kind = np.zeros(256, dtype=np.uint8)
        kind[33:127] = 1  # visible ASCII
        kind[np.r_[65:91, 97:123]] |= 2  # ASCII letter
        kind[[ord(c) for c in ".,;:!?"]] |= 4  # mark
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        import numpy as np

        self.keys = np.zeros(0, dtype=np.uint64)  # sorted first hashes
        self.proof = np.zeros(0, dtype=np.uint64)  # second hashes, in the order of keys
        self.begin = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _cuts(self, b, text_starts):
        """First bytes of the units of the joined texts ``b``."""
        import numpy as np

        k = self.kind[b]
        start = np.zeros(len(b) + 1, dtype=bool)
        shown = (k & 1) > 0
        prev = b[:-1]
        # a character of two bytes from U+00C0 on, or of three outside the blocks with spaces, is visible too
        wide = np.zeros(len(b), dtype=bool)
        if (b >= 128).any():
            wide[1:] = (b[1:] >= 128) & (b[1:] < 192) & (prev >= 0xC3) & (prev < 0xE0)
            lead = b[:-2]
            wide[2:] |= (b[2:] >= 128) & (b[2:] < 192) & ((lead == 0xE0) | ((lead >= 0xE4) & (lead < 0xF0)))
        seen = shown | wide
        start[1:-1] |= (b[1:] == 32) & seen[:-1]
        feed = np.flatnonzero((b[1:-1] == 10) & shown[:-2] & shown[2:]) + 1 if len(b) > 2 else np.zeros(0, dtype=int)
        start[feed] = True
        start[feed + 1] = True
        start[1:-1] |= ((k[1:] & 4) > 0) & ((k[:-1] & 2) > 0)
        start[text_starts] = True
        start[len(b):] = False
        return np.flatnonzero(start)

    def _one(self, raw: bytes) -> list[int] | None:
        """Ids of a unit that is one word, else None."""
        text = raw.decode()
        word = text[1:] if text[:1] == " " else text
        if not word.isalpha():
            return None
        return [t.id for t in self.tok.model.tokenize(raw.decode("latin-1").translate(self.spell))]

    def _encode_units(self, units: list[bytes]):
        """Ids of the units run together, and the count of each."""
        import numpy as np

        got = [self._one(u) for u in units]
        other = [i for i, x in enumerate(got) if x is None]
        for i, e in zip(other, self.tok.encode_batch_fast([units[i].decode() for i in other], add_special_tokens=False),
                        strict=True):
            got[i] = e.ids
        flat = np.fromiter((i for x in got for i in x), dtype=np.uint32)
        return flat, np.fromiter(map(len, got), dtype=np.int64, count=len(got))

    def encode(self, texts: list[str]):
        """All ids run together (uint32) and the number of ids of each text."""
        import numpy as np

        raws = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws))
        whole = b"".join(raws)
        if not whole:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(raws), dtype=np.int64)
        b = np.frombuffer(whole, dtype=np.uint8)
        text_starts = np.cumsum(sizes) - sizes
        cut = self._cuts(b, text_starts[sizes > 0])
        length = np.diff(np.append(cut, len(b)))
        within = np.arange(len(b), dtype=np.int32) - np.repeat(cut.astype(np.int32), length)
        np.minimum(within, LONG - 1, out=within)
        value = b.astype(np.uint64) + np.uint64(1)
        h1 = np.add.reduceat(self.mix[0][within] * value, cut)
        h2 = np.add.reduceat(self.mix[1][within] * value, cut) ^ length.astype(np.uint64)
        del within, value
        long = length > LONG
        keys, first, back = np.unique(h1, return_index=True, return_inverse=True)
        # a long unit's hash covers it poorly, and equal first hashes may differ in the second: those go alone
        alone = long | (h2 != h2[first][back])
        if len(self.keys) > MOST_UNITS:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            inside = np.minimum(at, len(self.keys) - 1)
            known = self.keys[inside] == keys
            clash = known & (self.proof[inside] != h2[first])
            alone |= clash[back]
        new = np.flatnonzero(~known & ~alone[first])
        if len(new):
            where = first[new]
            flat, n = self._encode_units([whole[s:s + k] for s, k in zip(cut[where].tolist(), length[where].tolist(),
                                                                        strict=True)])
            order = np.searchsorted(self.keys, keys[new])
            self.begin = np.insert(self.begin, order, len(self.ids) + np.cumsum(n) - n)
            self.count = np.insert(self.count, order, n)
            self.proof = np.insert(self.proof, order, h2[where])
            self.keys = np.insert(self.keys, order, keys[new])
            self.ids = np.concatenate([self.ids, flat])
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        if len(self.keys):
            begin, count, ids = self.begin[at][back], self.count[at][back], self.ids
        else:
            begin, count, ids = np.zeros(len(cut), dtype=np.int64), np.zeros(len(cut), dtype=np.int64), self.ids
        odd = np.flatnonzero(alone)
        if len(odd):
            flat, n = self._encode_units([whole[s:s + k] for s, k in zip(cut[odd].tolist(), length[odd].tolist(),
                                                                        strict=True)])
            begin[odd], count[odd] = len(ids) + np.cumsum(n) - n, n
            ids = np.concatenate([ids, flat])
        ends = np.cumsum(count)
        out = ids[np.arange(int(ends[-1])) + np.repeat(begin - (ends - count), count)]
        total = np.concatenate([[0], ends])
        edge = np.searchsorted(cut, np.append(text_starts, len(b)))
        return out, total[edge[1:]] - total[edge[:-1]]


def batches(texts: list[str | None], n_chars: int = 1 << 21):
    """Runs of texts with about ``n_chars`` characters: (first index, texts); None counts as empty."""
    at, run, size = 0, [], 0
    for i, t in enumerate(texts):
        run.append(t or "")
        size += len(run[-1])
        if size >= n_chars:
            yield at, run
            at, run, size = i + 1, [], 0
    if run:
        yield at, run
