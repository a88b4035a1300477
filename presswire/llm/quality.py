"""Compression bands: zstandard ratios of whole documents and fixed chunks, beside base counts."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import tune

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Own limits at level 3: (UTF-8 bytes from, least ratio, most ratio, most gain).  The ratio is compressed / raw;
#: the gain is compressed / the size that the text's byte frequencies alone would give, which prose beats by its
#: words and random letters never do.  Measured on at most 2 000 documents of each language of the test tables
#: (prose at 0.6, 1, 2, 4, 8 and 24 kB: ratio up to 0.67, 0.60, 0.53, 0.49, 0.45, 0.43; gain up to 1.26, 1.13, 1.04,
#: 0.98, 0.93, 0.88) against base64, base85, hex and digits (ratio from 0.74; gain from 1.11, 1.07, 1.03, 1.02, 1.01, 1.01).
BANDS = ((0, 0.0, 9.9, 9.9), (128, 0.12, 1.10, 9.9), (512, 0.12, 0.74, 1.05), (1024, 0.12, 0.70, 1.03),
         (2048, 0.12, 0.62, 1.01), (4096, 0.10, 0.58, 1.0), (8192, 0.08, 0.58, 0.985))
#: Scripts beyond ASCII spell a letter in 2 to 4 bytes of few leading values: only their own limits differ.
WIDE_BANDS = ((0, 0.0, 9.9, 9.9), (128, 0.08, 1.10, 9.9), (512, 0.08, 0.92, 1.10), (1024, 0.08, 0.88, 1.08),
              (2048, 0.08, 0.84, 1.05), (4096, 0.06, 0.80, 1.02), (8192, 0.05, 0.78, 1.0))
#: Share of non-ASCII bytes from which WIDE_BANDS hold.
WIDE_SHARE = 0.3
#: Below EVEN_BYTES the gains of prose and of random letters overlap, so there the gain only counts where the bytes
#: are spread evenly (entropy / logarithm of the number of distinct bytes; prose has 0.75 to 0.85, dumps over 0.95).
EVEN_BYTES, EVEN = 4096, 0.92
#: Chunks are of CHUNK_BYTES, those of texts under 4 * CHUNK_BYTES a quarter of it.
CHUNK_BYTES = 4096
#: A document goes if more than this share of its chunks lies outside the band of the chunk's length.
CHUNK_SHARE = 0.34
LEVEL = 3

METRICS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "ratio double, gain double, n_chunks long, n_bad_chunks long, base_failed boolean, kept boolean")


def outside(raw: bytes, compress, bands=BANDS, wide=WIDE_BANDS) -> tuple[bool, float, float]:
    """Whether ``raw`` (not empty) leaves the band of its length and script; its ratio and gain."""
    import numpy as np

    n = len(raw)
    size = len(compress(raw))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    some = counts[counts > 0]
    bits = float(n * np.log2(n) - (some * np.log2(some)).sum())  # of all bytes together
    ratio, gain = size / n, 8 * size / max(bits, 8.0)
    even = bits / (n * np.log2(len(some))) if len(some) > 1 else 0.0
    _, low, high, most = [b for b in (wide if counts[128:].sum() >= WIDE_SHARE * n else bands) if n >= b[0]][-1]
    noise = gain > most and (n >= EVEN_BYTES or even > EVEN)
    # one byte value over and over has no frequencies to beat: its low ratio decides
    return bool(ratio < low or ratio > high or (noise and len(some) > 1)), ratio, gain


def repeat_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    m = len(ids)
    if m == n:
        return 0
    if m < 2_000_000:
        key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:  # three ids no longer fit into 63 bits: number the pairs first
        pair = np.unique(w[:-1] * m + w[1:], return_inverse=True)[1]
        key = pair[:-1] * m + w[2:]
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    again = np.zeros(n - 2, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    for i in range(3):
        hit[i:n - 2 + i] |= again
    return int(hit.sum())


def measure(text: str | None, compress, bands=BANDS, chunk=CHUNK_BYTES, share=CHUNK_SHARE, wide=WIDE_BANDS) -> tuple:
    """The METRICS of one text; None counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(raw.translate(None, WHITE).decode("utf-8"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = Counter(x for x in raw.split(b"\n") if x.strip(WHITE))
    dup = sum(lines.values()) - len(lines)
    repeats = repeat_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    out, ratio, gain = outside(raw, compress, bands, wide) if raw else (True, None, None)
    step = chunk if len(raw) >= 4 * chunk else chunk // 4
    starts = range(0, max(1, len(raw) - step // 2), step)  # a rest under half a chunk belongs to the chunk before it
    parts = [raw[a:b] for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)] if len(starts) > 1 else []
    bad = sum(outside(p, compress, bands, wide)[0] for p in parts)
    kept = not failed and not out and bad <= share * len(parts)
    return n, chars, symbols, dup, repeats, ratio, gain, len(parts), bad, failed, kept


def metrics_udf(bands=BANDS, chunk: int = CHUNK_BYTES, share: float = CHUNK_SHARE, level: int = LEVEL, wide=WIDE_BANDS):
    """Arrow-batched column function: text -> struct of METRICS."""

    names = [x.split()[0] for x in METRICS.split(", ")]

    @F.pandas_udf(METRICS)
    def rules(text: pd.Series) -> pd.DataFrame:
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress
        return pd.DataFrame([measure(t, compress, bands, chunk, share, wide) for t in text], columns=names)

    return rules.asNondeterministic()  # evaluated once, also below a filter on its result


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and the METRICS of every document, row by row (no shuffle).

    ``kept`` is false if the base rules fail (under 50 words, or over half of the words in
    repeated 3-word windows), if the whole text leaves the band of its length and script (ratio too
    low: repetitive; ratio or gain too high: incompressible), or if over a third of its chunks do.
    Null and empty texts have no words: base_failed, not kept, ratio and gain null.  Very long texts
    are judged whole and in all their chunks.  No order is involved, so ties can't arise; repeated
    rows each give a row; an empty table gives none; extra columns are not read.
    """
    tune(docs.sparkSession)
    return docs.select("doc_id", metrics_udf(**limits)("text").alias("q")).select("doc_id", "q.*")


def filter_quality(docs: DataFrame, **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Null and empty texts fail the base rules and go; repeated rows stay or go together; an empty
    table gives an empty one.
    """
    tune(docs.sparkSession)
    return docs.where(metrics_udf(**limits)("text")["kept"])
