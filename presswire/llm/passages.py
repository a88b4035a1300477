"""Substring dedup by repeated-phrase automata: windows of words that occurred earlier are cut out of every text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import numbered, stored, tune

WINDOW = 20
#: Words of an anchor: of the anchors in a window the one with the least hash stands for it, so equal
#: windows have equal anchors at equal places, and every repeated window shows as a repeated anchor.
ANCHOR = 8
#: Occurrences of candidate windows that one shard's automaton and pieces stand for, about.
SHARD_WINDOWS = 150_000
#: Phrases of one automaton: a task with more compiles them in turn.
MACHINE_PHRASES = 200_000
#: Letters of a phrase that one long holds, at 11 bits each.
PER_LONG, LETTER_BITS = 5, 11
SPELLING = [f"l{i}" for i in range(WINDOW // PER_LONG)]
#: Shards up to which the table of hot ones is broadcast.
MOST_BROADCAST = 100_000
#: Bits of a place in a document (words); the document's number stands above them.
PLACE_BITS = 29

_P = 0x9E3779B97F4A7C15
_Q = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def _mixed(h):
    """Finaliser: every bit of the sum reaches every bit of the hash."""
    import numpy as np

    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(raws: list[bytes]):
    """64-bit hashes of the words (runs without ASCII white space) of the texts, run together, and counts."""
    import numpy as np

    whole = b"\n".join(raws) + b"\n"
    b = np.frombuffer(whole, dtype=np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = end - begin
    text_end = np.cumsum([len(r) + 1 for r in raws])
    counts = np.diff(np.concatenate([[0], np.searchsorted(begin, text_end)]))
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), counts
    power = np.empty(int(length.max()), dtype=np.uint64)
    power[0] = 1
    power[1:] = np.uint64(_P)
    np.multiply.accumulate(power, out=power)
    chars = b[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(length) - length
    place = np.arange(len(chars)) - np.repeat(first, length)
    sums = np.add.reduceat(chars * power[place], first)
    return _mixed(sums + length.astype(np.uint64) * np.uint64(_Q[0])), counts


def run_hashes(words, n: int, lane: int = 0):
    """Hash of every run of ``n`` consecutive words."""
    import numpy as np

    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    # runs of the leading bits of n are doubled, and a word added where a bit is set
    out, size = words, 1
    for bit in bin(n)[3:]:
        out = out[:len(out) - size] * np.uint64(pow(_Q[lane], size, 1 << 64)) + out[size:]
        size *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(_Q[lane]) + words[size:]
            size += 1
    return _mixed(out)


def chosen_anchors(words):
    """Place of the anchor that stands for each window (leftmost of the least), and the anchors' hashes by place."""
    import numpy as np

    if len(words) < WINDOW:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = run_hashes(words, ANCHOR)
    span = WINDOW - ANCHOR + 1
    # least of spans of 2, 4, 8, then of two that overlap; at ties the left one stays
    least, at, size = h, np.arange(len(h)), 1
    while size < span:
        step = min(size, span - size)
        left, right = least[:len(least) - step], least[step:]
        at = np.where(right < left, at[step:], at[:len(at) - step])
        least = np.minimum(left, right)
        size += step
    return at, h


def _split(words, counts):
    import numpy as np

    at = np.concatenate([[0], np.cumsum(counts)])
    return [words[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def letters(words) -> str:
    """One character of two bytes for each word (of 1 920): what the automata read."""
    import numpy as np

    return (words % np.uint64(1920) + np.uint64(128)).astype("<u2").tobytes().decode("utf-16-le")


def spelled(words, starts):
    """The letters of the windows at ``starts``, one column for each of SPELLING."""
    import numpy as np

    letter = words % np.uint64(1920)
    m = len(letter) - PER_LONG + 1
    packed = np.zeros(m, dtype=np.uint64)
    for i in range(PER_LONG):
        packed |= letter[i:m + i] << np.uint64(LETTER_BITS * i)
    return [packed[starts + PER_LONG * i].view(np.int64) for i in range(len(SPELLING))]


def unspelled(columns) -> list[str]:
    """The phrases that ``spelled`` packed, as ``letters`` writes them."""
    import numpy as np

    packed = np.stack([np.asarray(c, dtype=np.int64).view(np.uint64) for c in columns], axis=1)
    shift = np.uint64(LETTER_BITS) * np.arange(PER_LONG, dtype=np.uint64)
    each = (packed[:, :, None] >> shift) & np.uint64((1 << LETTER_BITS) - 1)
    text = (each.reshape(-1) + np.uint64(128)).astype("<u2").tobytes().decode("utf-16-le")
    return [text[i:i + WINDOW] for i in range(0, len(text), WINDOW)]


def occurrences(phrases, pieces, automaton=None):
    """(piece, offset, first place) of every occurrence of ``phrases`` (letters, h1, first place) in ``pieces`` (letters, hashes).

    The automaton, compiled from the phrases' letters alone, finds the places; the 64-bit hash of a found window then
    tells phrases apart whose words differ but are spelled alike.
    """
    if automaton is None:
        import ahocorasick
        automaton = ahocorasick.Automaton
    for at in range(0, len(phrases), MACHINE_PHRASES):
        machine, alike = automaton(), {}
        for text, h1, first in phrases[at:at + MACHINE_PHRASES]:
            if machine.get(text, None) is None:
                machine.add_word(text, (h1, first))
            else:  # spelled like another one
                alike.setdefault(text, []).append((h1, first))
        machine.make_automaton()
        for number, (text, hashes) in enumerate(pieces):
            for end, (h1, first) in machine.iter(text):
                offset = end - WINDOW + 1
                if h1 == hashes[offset]:
                    yield number, offset, first
                elif alike:
                    for other, its in alike.get(text[offset:end + 1], ()):
                        if other == hashes[offset]:
                            yield number, offset, its


# --- jobs ---------------------------------------------------------------------------

def surveyed(docs: DataFrame) -> DataFrame:
    """One row per document: row id, doc_id, text id, words, digest of all words, its anchors and places."""
    def survey(frames):
        import hashlib

        import numpy as np
        import pandas as pd

        for pdf in frames:
            raws = [(t or "").encode("utf-8", "replace") for t in pdf["text"]]
            words, counts = word_hashes(raws)
            anchors, places = [], []
            for w in _split(words, counts):
                at, h = chosen_anchors(w)
                at = np.unique(at)
                anchors.append(h[at].view(np.int64))
                places.append(at.astype(np.int32))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tid": pdf["tid"], "n_words": counts,
                                "digest": [hashlib.sha256(b" ".join(r.split())).hexdigest() for r in raws],
                                "anchors": anchors, "places": places})

    found = docs.mapInPandas(survey, "doc_id long, tid string, n_words long, digest string, anchors array<long>, places array<int>")
    return found.withColumn("rid", F.monotonically_increasing_id())


def candidate_windows(texts: DataFrame, n_shards) -> DataFrame:
    """(shard, h1, letters, place) of every window whose anchor recurs; ``texts``: num, text, at (recurring places)."""
    def windows(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            raws = [t.encode("utf-8", "replace") for t in pdf["text"]]
            words, counts = word_hashes(raws)
            out = []
            for num, at, w in zip(pdf["num"].tolist(), pdf["at"], _split(words, counts), strict=True):
                chosen, h = chosen_anchors(w)
                start = np.flatnonzero(np.isin(chosen, np.asarray(at)))
                if len(start):
                    shard = (h[chosen[start]] % np.uint64(n_shards)).astype(np.int64)
                    out.append((shard, run_hashes(w, WINDOW)[start].view(np.int64), *spelled(w, start), (num << PLACE_BITS) + start))
            if out:
                yield pd.DataFrame({c: np.concatenate([o[i] for o in out]) for i, c in enumerate(("shard", "h1", *SPELLING, "place"))})

    return texts.select("num", "text", "at").mapInPandas(
        windows, ", ".join(f"{c} long" for c in ("shard", "h1", *SPELLING, "place")))


def candidate_pieces(texts: DataFrame, n_shards) -> DataFrame:
    """(shard, place, words, h1): for each recurring anchor the stretch of words of the windows it stands for."""
    def pieces(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            raws = [t.encode("utf-8", "replace") for t in pdf["text"]]
            words, counts = word_hashes(raws)
            out = {"shard": [], "place": [], "words": [], "h1": []}
            for num, at, w in zip(pdf["num"].tolist(), pdf["at"], _split(words, counts), strict=True):
                chosen, h = chosen_anchors(w)
                if not len(chosen):
                    continue
                # windows with one anchor follow each other
                cut = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
                ends = np.append(cut[1:], len(chosen))
                known = np.isin(chosen[cut], np.asarray(at))
                cut, ends = cut[known], ends[known]
                text, hashes = letters(w), run_hashes(w, WINDOW).tobytes()
                spans = list(zip(cut.tolist(), ends.tolist(), strict=True))
                out["shard"] += (h[chosen[cut]] % np.uint64(n_shards)).astype(np.int64).tolist()
                out["place"] += ((num << PLACE_BITS) + cut).tolist()
                out["words"] += [text[s:e + WINDOW - 1] for s, e in spans]
                out["h1"] += [hashes[8 * s:8 * e] for s, e in spans]
            if out["shard"]:
                yield pd.DataFrame(out)

    return texts.select("num", "text", "at").mapInPandas(
        pieces, "shard long, place long, words string, h1 binary")


def located(pieces: DataFrame, phrases: DataFrame, n_shards: int) -> DataFrame:
    """(num, starts): windows that are not the first of their phrase, found by each shard's automaton.

    ``phrases`` (shard, h1, letters, first, n): the confirmed recurring windows.  A task holds one salt of one shard:
    it compiles the shard's phrases into Aho-Corasick automata (of MACHINE_PHRASES each) and streams its pieces through
    them.  A shard with many occurrences has many salts.
    """
    hot = phrases.groupBy("shard").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / (2 * SHARD_WINDOWS))).cast("long").alias("salts")).where("salts > 1")
    hot = F.broadcast(hot) if n_shards <= MOST_BROADCAST else hot  # one row per shard at most
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    dealt = pieces.join(hot, "shard", "left").withColumn("salt", F.pmod(F.xxhash64("place"), salts)).drop("salts")
    spread = phrases.join(hot, "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts", "n")

    def locate(key, left, right):
        import numpy as np
        import pandas as pd

        found: dict[int, list[int]] = {}
        if len(left) and len(right):
            phrases = list(zip(unspelled([right[c] for c in SPELLING]), right["h1"].tolist(), right["first"].tolist(), strict=True))
            places = left["place"].tolist()
            pieces = list(zip(left["words"], [np.frombuffer(x, "<i8").tolist() for x in left["h1"]], strict=True))
            for number, offset, first in occurrences(phrases, pieces):
                if first < places[number] + offset:
                    found.setdefault(places[number], []).append((places[number] & ((1 << PLACE_BITS) - 1)) + offset)
        return pd.DataFrame({"num": pd.Series([x >> PLACE_BITS for x in found], dtype="int64"),
                             "starts": pd.Series(list(found.values()), dtype=object)})

    return (dealt.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt"))
            .applyInPandas(locate, "num long, starts array<int>"))


def cut_out(texts: DataFrame) -> DataFrame:
    """(num, n_removed, kept_sha256[, kept text]) of ``texts``: num, text, starts (windows to go)."""
    def cut(frames):
        import hashlib

        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for num, text, starts in zip(pdf["num"].tolist(), pdf["text"], pdf["starts"], strict=True):
                words = text.encode("utf-8", "replace").split()
                change = np.zeros(len(words) + 1, dtype=np.int64)
                s = np.unique(np.asarray(starts))
                change[s] += 1
                np.subtract.at(change, s + WINDOW, 1)
                gone = np.cumsum(change)[:-1] > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                out.append((num, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pd.DataFrame(out, columns=["num", "n_removed", "kept_sha256", "kept"])

    return texts.select("num", "text", "starts").mapInPandas(cut, "num long, n_removed long, kept_sha256 string, kept string")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Remove each word covered by a 20-word window whose word sequence starts earlier.

    1. Every text is surveyed once: its anchors (stored), number of words and digest.
    2. Anchors that occur twice or more lead to the candidate windows of the texts that hold them; of exact
       copies of a text only the first goes on, as every window of the others starts earlier.
    3. Candidate windows are counted (pre-aggregated, by a 64-bit hash and their letters of 218 bits): those that
       occur twice are the confirmed phrases, with their first place.
    4. Phrases and the pieces of text around their anchors meet by shard of the anchor; automata compiled from
       the phrases' letters find every occurrence, the hash confirms it, and the windows behind the first go.

    Returns doc_id, n_words, n_removed, kept_sha256.  The order of documents is that of doc_id, a null
    doc_id last, ties by text; rows with equal doc_id and text are one document.  Null, empty and blank texts
    have no words (digest of the empty string).  Very long texts are read whole, up to 2^29 words.  An empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tid", F.md5("text"))
    all_ = stored(surveyed(docs), "op6")
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    slim = all_.select("rid", "doc_id", "tid", "n_words", "digest", order.alias("ord"))
    # the first of each text's copies; of repeated rows the one with the least row id
    first_ord = slim.groupBy("tid").agg(F.min("ord").alias("ord"))
    firsts = slim.join(first_ord, ["tid", "ord"]).groupBy("tid", "ord").agg(F.min("rid").alias("rid"), F.count("*").alias("rows"))
    nums, n_texts = numbered(firsts.select("rid", "ord", "tid", "rows"), ["ord", "tid"], "num", "op6")
    nums = stored(nums, "op6")

    seen = all_.select(F.explode("anchors").alias("anchors"))
    own = (all_.select("rid", F.arrays_zip("anchors", "places").alias("x")).join(nums.select("rid", "num"), "rid")
           .select("num", F.explode("x").alias("x")).select("num", "x.anchors", "x.places"))
    # stored, so that both sides of the join are plain shuffles and a hot anchor's rows can be split
    often = stored(seen.groupBy("anchors").agg(F.count("*").alias("n")).where("n > 1").select("anchors"), "op6")
    hits = (own.join(often, "anchors").groupBy("num").agg(F.collect_list("places").alias("at")))
    hits = stored(hits, "op6")
    wanted = hits.join(nums, "num").select("num", "at", F.when(F.col("ord") < (1 << 63) - 1, F.col("ord")).alias("doc_id"), "tid")
    texts = docs.withColumn("ord", order).join(wanted.withColumn("ord", order).drop("doc_id"), ["ord", "tid"]).select("num", "text", "at")
    if nums.where("rows > 1").limit(1).count():
        texts = texts.dropDuplicates(["num"])
    texts = stored(texts, "op6")

    n_windows = hits.agg(F.sum(F.size("at"))).first()[0] or 0
    # an anchor stands for (20 - 8 + 2) / 2 windows on average
    n_shards = max(1, -(-n_windows * (WINDOW - ANCHOR + 2) // (2 * SHARD_WINDOWS)))
    phrases = (candidate_windows(texts, n_shards).groupBy("shard", "h1", *SPELLING)
               .agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1"))
    phrases = stored(phrases, "op6")
    found = located(candidate_pieces(texts, n_shards), phrases, n_shards)
    starts = stored(found.groupBy("num").agg(F.flatten(F.collect_list("starts")).alias("starts")), "op6")
    cut = cut_out(texts.join(starts, "num")).select("num", "n_removed", "kept_sha256")

    done = nums.select("tid", "ord", "num").join(cut, "num", "left")
    rows = slim.join(done, ["tid", "ord"], "left")
    later = F.col("num").isNull() & (F.col("n_words") >= WINDOW)
    nothing = F.sha2(F.lit(""), 256)
    return rows.select("doc_id", "n_words",
                       F.when(later, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                       F.when(later, nothing).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))
