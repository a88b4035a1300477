"""Gold-layer enrichment operators: keyword classification, ministry lookup,
lexicon polarity, sentiment scores.

Everything is computed on the row itself, so the gold step is map-side: no
shuffle.  Cleaning, polarity and scores are Column expressions; the keyword
classifier defaults to one Aho-Corasick pass in an Arrow-batched pandas UDF
(measured 10x faster than 190 substring scans) with the pure expression
form as an option.  Each
lookup that could grow with user input (keyword map, lexicon, ministry
table) has a DataFrame-join form as well, for tables too big to inline; the
planner broadcasts such a table when its bytes are below the threshold.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from presswire import constants as C
from presswire.functions import scores as S
from presswire.functions.text import is_blank
from presswire.operators.membership import bloom_filter, filter_bits, where_held
from presswire.operators.rules import compute_once
from presswire.session import checkpoint_dir, stored

#: Characters of a keyword's q-gram (a shorter keyword is filed under all of it).
GRAM = 4
#: Of the texts, one in so many is counted to tell which q-grams are rare.  Any choice gives the same answer.
GRAM_SAMPLE = 16
#: At most so many q-grams are dealt out over salts, the most frequent ones, over so many salts each.
HOT_GRAMS, GRAM_SALTS = 64, 16
#: Characters of a long text that are looked at together.
STRETCH = 1 << 16


# ---------------------------------------------------------------------------
# cls_keyword / cls_keyword_small / cls_blank
# ---------------------------------------------------------------------------

def keyword_scores(text: Column, keyword_map: Mapping[str, list[str]], lowered: bool = False) -> list[Column]:
    """Per category: number of distinct keywords that occur as substrings.

    A flat sum of ``instr`` tests (no lambda), so the lower-cased text is a
    common subexpression evaluated once per row.
    """
    low = text if lowered else F.lower(text)
    out = []
    for cat, kws in keyword_map.items():
        terms = [(F.instr(low, k) > F.lit(0)).cast("int") for k in dict.fromkeys(kws)]
        out.append(_sum(terms).alias(cat))
    return out


def _sum(terms: list[Column]) -> Column:
    """Their sum as a balanced tree, so that many terms stay shallow."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + terms[len(terms) // 2 * 2:]
    return terms[0] if terms else F.lit(0)


def best_category(text: Column, keyword_map: Mapping[str, list[str]] | None = None,
                  lowered: bool = False) -> Column:
    """struct(score, neg_rank, category) of the winning category (ties -> first declared)."""
    kmap = keyword_map or C.KEYWORD_MAP
    scored = [F.struct(sc.alias("score"), F.lit(-rank).alias("neg_rank"), F.lit(cat).alias("category"))
              for rank, (cat, sc) in enumerate(zip(kmap.keys(), keyword_scores(text, kmap, lowered)))]
    return F.array_max(F.array(*scored))


def pick_category(text: Column, best: Column, default: str = C.DEFAULT_CATEGORY) -> Column:
    return (F.when(text.isNull(), F.lit(default))
            .when(best["score"] > F.lit(0), best["category"])
            .otherwise(F.lit(default)))


def classify_keywords(text: Column, keyword_map: Mapping[str, list[str]] | None = None,
                      default: str = C.DEFAULT_CATEGORY, lowered: bool = False) -> Column:
    """cls_keyword: category with most distinct keyword hits.

    Substring containment on the lower-cased text ("ai" hits "said"); ties go
    to the category declared first; no hit or NULL text -> ``default``.
    As a bare Column the winner struct is referenced twice; ``with_category``
    stages it so it is computed once per row.
    """
    return pick_category(text, best_category(text, keyword_map, lowered), default)


def with_category(df: DataFrame, text_col: str, out_col: str = "category",
                  keyword_map: Mapping[str, list[str]] | None = None,
                  default: str = C.DEFAULT_CATEGORY, method: str = "automaton") -> DataFrame:
    """cls_keyword as a DataFrame step.

    ``method="automaton"`` (default): one Aho-Corasick pass per text in an
    Arrow-batched pandas UDF finds every keyword occurrence at once; measured
    about 10x faster than the expression form at sf0.1, whose cost is one
    full-text scan per keyword (190 scans).  ``method="expr"``: lower-cased
    text, then the winner struct, each in its own projection (JVM only).
    Both give the same category for every row.
    """
    if method == "automaton":
        kmap = dict(keyword_map or C.KEYWORD_MAP)
        return df.withColumn(out_col, _automaton_udf(kmap, default)(F.col(text_col)))
    staged = df.withColumn("_low", F.lower(F.col(text_col)))
    staged = staged.withColumn("_best", best_category(F.col("_low"), keyword_map, lowered=True))
    return (staged.withColumn(out_col, pick_category(F.col(text_col), F.col("_best"), default))
            .drop("_low", "_best"))


_AUTOMATA: dict = {}


def _automaton_udf(kmap: dict, default: str):
    """pandas UDF: text -> category by distinct keyword hits (ties: first declared)."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    cats = list(kmap)
    words: dict[str, list[int]] = {}
    for ci, (cat, kws) in enumerate(kmap.items()):
        for k in dict.fromkeys(kws):
            words.setdefault(k, []).append(ci)
    key = repr(sorted(words.items()))

    def automaton():
        a = _AUTOMATA.get(key)
        if a is None:
            import ahocorasick
            a = ahocorasick.Automaton()
            for w, idx in words.items():
                a.add_word(w, (w, tuple(idx)))
            a.make_automaton()
            _AUTOMATA[key] = a
        return a

    def classify(series: pd.Series) -> pd.Series:
        a = automaton()

        def one(x):
            if x is None:
                return default
            found = {v for _, v in a.iter(x.lower())}
            scores = [0] * len(cats)
            for _, idx in found:
                for ci in idx:
                    scores[ci] += 1
            best = max(scores)
            return cats[scores.index(best)] if best > 0 else default
        return series.map(one)

    classify.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return pandas_udf(classify, "string")


def classify_blank_default(text: Column, classified: Column,
                           default: str = C.DEFAULT_CATEGORY) -> Column:
    """cls_blank: blank text -> default category, else the classifier's answer."""
    return F.when(is_blank(text), F.lit(default)).otherwise(classified)


def keyword_dim(spark, keyword_map: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Keyword map as a (category, rank, keyword) DataFrame."""
    kmap = keyword_map or C.KEYWORD_MAP
    rows = [(cat, rank, kw) for rank, (cat, kws) in enumerate(kmap.items()) for kw in dict.fromkeys(kws)]
    return spark.createDataFrame(rows, "category string, rank int, keyword string")


def _runs(text: Column, least: int, most: int) -> Column:
    """The ``least`` to ``most`` characters from every place on that has as many."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{least},{most}}}))."), F.lit(1))


def gram_index(df: DataFrame, text_col: str, keywords: DataFrame) -> DataFrame:
    """The keywords, each filed under its rarest q-gram: (category, rank, keyword, size, gram, texts).

    A gram has min(GRAM, length of the keyword) characters.  Rarity is the number of texts that hold the gram,
    counted on one text in GRAM_SAMPLE (by hash), with only the keywords' own grams shuffled.
    """
    kw = keywords.select("category", "rank", "keyword").where(F.length("keyword") > 0).withColumn(
        "size", F.least(F.length("keyword"), F.lit(GRAM)))
    grams = F.coalesce(*[F.when(F.col("size") == n, F.array_distinct(_runs(F.col("keyword"), n, n))) for n in range(1, GRAM + 1)])
    filed = kw.withColumn("gram", F.explode(grams))
    held = F.array_distinct(F.concat(F.array().cast("array<string>"), *[_runs(F.col("_low"), n, n) for n in gram_sizes(kw)]))
    some = (df.where(F.pmod(F.xxhash64(text_col), F.lit(GRAM_SAMPLE)) == 0).select(F.lower(F.col(text_col)).alias("_low"))
            .select(F.explode(held).alias("gram")))
    counts = where_held(some, F.col("gram"), filed.select("gram").distinct(), "gram").groupBy("gram").agg(
        F.count(F.lit(1)).alias("texts"))
    rarest = Window.partitionBy("keyword", "category").orderBy("texts", "gram")
    return (filed.join(counts, "gram", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
            .withColumn("_nth", F.row_number().over(rarest)).where("_nth = 1")
            .select("category", "rank", "keyword", "size", "gram", "texts"))


def gram_sizes(kw: DataFrame) -> list[int]:
    """The gram lengths in use, GRAM at most."""
    return sorted(r[0] for r in kw.select("size").distinct().collect())


#: Factors of a gram's characters in the hashes that its filter is probed with: products of code points stay below 2^54.
GRAM_FACTORS = [(1640531527, 1013904243, 1812433253, 1566083941), (1103515245, 1664525013, 1284865837, 2027808485),
                (1376312589, 1597334677, 1220703125, 1951559743)]


def gram_slots(gram: Column, bits: int) -> list[Column]:
    """The filter's bits that stand for a gram, as ``hits_in`` works them out from code points."""
    return [F.shiftright(_sum([F.coalesce(F.ascii(F.substring(gram, i + 1, 1)).cast("bigint"), F.lit(0).cast("bigint")) * F.lit(f)
                               for i, f in enumerate(factors)]), 20).bitwiseAND(F.lit(bits - 1)) for factors in GRAM_FACTORS]


def hits_in(codes, n: int, bloom):
    """Places of ``codes`` (code points) where a gram of ``n`` characters begins that the filter may hold."""
    import numpy as np

    codes, bits = codes.astype(np.int64), 64 * len(bloom)
    places, at = max(len(codes) - n + 1, 0), None
    for factors in GRAM_FACTORS:    # each probe looks only at what the ones before it let through
        there = (codes[i:i + places] if at is None else codes[at + i] for i in range(n))
        slot = sum((c * f for c, f in zip(there, factors)), np.zeros(1, np.int64)) >> 20 & (bits - 1)
        held = np.flatnonzero((bloom[slot >> 6] >> (slot & 63)) & 1) if places else np.zeros(0, np.int64)
        at = held if at is None else at[held]
    return at


def _windows(text: str, sizes: list[int], ahead: int, longest: int, bloom) -> set[tuple[str, str]]:
    """(gram, window) of every place of ``text`` over which a filed gram may lie, a stretch at a time."""
    import numpy as np

    found = set()
    for start in range(0, len(text), STRETCH):
        piece = text[start:start + STRETCH + GRAM - 1]
        codes = np.frombuffer(piece.encode("utf-32-le"), dtype="<u4")
        for n in sizes:
            for p in hits_in(codes, n, bloom).tolist():
                if n < GRAM:
                    found.add((piece[p:p + n],) * 2)
                elif p < STRETCH:
                    found.add((piece[p:p + n], text[max(start + p - ahead, 0):start + p + longest]))
    return found


def keyword_candidates(df: DataFrame, key: str, text_col: str, index: DataFrame) -> DataFrame:
    """What the texts send to the index: (key, gram, window), one row per distinct window over a filed gram.

    A window holds every keyword that lies over its gram; a gram shorter than GRAM is a whole keyword and its
    own window.  The grams of an Arrow batch are hashed at once and looked up in a Bloom filter of bounded size, so
    that strings are made only where a gram may be filed.  Each text also sends one row without a gram.
    """
    longest = index.agg(F.max(F.length("keyword"))).first()[0] or 1
    ahead, sizes = max(longest - GRAM, 0), gram_sizes(index)      # where the gram of a window begins
    grams = index.select("gram").distinct()
    words = bloom_filter(grams, "gram", filter_bits(grams.count()), gram_slots).first()[0]

    def sent(batches):
        import numpy as np
        import pyarrow as pa

        bloom = np.array(words, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, gram, window = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    found = sorted(_windows(text or "", sizes, ahead, longest, bloom))
                    rows += [i] * (len(found) + 1)
                    gram += [None, *[g for g, _ in found]]
                    window += [None, *[w for _, w in found]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(gram, pa.string()),
                                                  pa.array(window, pa.string())], names=[key, "gram", "window"])

    schema = StructType([StructField(key, df.schema[key].dataType), StructField("gram", StringType()), StructField("window", StringType())])
    return df.select(key, F.lower(F.col(text_col)).alias("_low")).mapInArrow(sent, schema)


def classify_keywords_join(df: DataFrame, key: str, text_col: str, keywords: DataFrame,
                           default: str = C.DEFAULT_CATEGORY) -> DataFrame:
    """join_keyword: ``contains(text, keyword)`` as an equality join on rare q-grams, then the winner per key.

    Every keyword is filed under the q-gram of its own that fewest texts hold (``gram_index``).  A text sends only
    the places whose q-gram is filed (a Bloom filter in the same stage; the texts are stored once, for both) with the characters around them, and a
    keyword that meets such a place is looked up in that window.  So the rows sent are about as many as the
    hits, and a keyword table of any size can be joined.  The q-grams with the most texts are dealt out over
    salts, their keywords repeated for each.  ``key`` names one text; a key without any hit gets ``default``.
    Returns (key, category).
    """
    checkpoint_dir(df.sparkSession)
    df = stored(df.select(key, text_col), "keyword-texts")      # read for the index and for the windows
    index = gram_index(df, text_col, keywords).checkpoint()     # the size of the keyword table
    hot = [r[0] for r in index.where("texts > 0").groupBy("gram").agg(F.max("texts").alias("n"))
           .orderBy(F.desc("n"), "gram").limit(HOT_GRAMS).collect()]

    def salted(gram: Column, salt: Column) -> Column:
        return F.when(gram.isin(*hot), salt).otherwise(F.lit(0)) if hot else F.lit(0)

    sent = keyword_candidates(df, key, text_col, index).withColumn(
        "_salt", salted(F.col("gram"), F.pmod(F.xxhash64(key, "window"), F.lit(GRAM_SALTS)).cast("int")))
    salts = F.when(F.col("gram").isin(*hot), F.sequence(F.lit(0), F.lit(GRAM_SALTS - 1))).otherwise(F.array(F.lit(0))) if hot \
        else F.array(F.lit(0))
    filed = index.select("category", "rank", "keyword", "gram", F.explode(salts).alias("_salt"))
    hits = (sent.join(filed, ["gram", "_salt"], "left")
            .groupBy(key, "category", "rank").agg(F.count_distinct(F.when(F.contains("window", "keyword"), F.col("keyword"))).alias("score")))
    best = hits.groupBy(key).agg(F.max(F.when(F.col("score") > 0, F.struct(
        F.col("score"), (-F.col("rank")).alias("nr"), F.col("category")))).alias("b"))
    return best.select(key, F.coalesce(F.col("b.category"), F.lit(default)).alias("category"))


# ---------------------------------------------------------------------------
# join_ministry
# ---------------------------------------------------------------------------

def ministry_of(category: Column, ministry_map: Mapping[str, str] | None = None) -> Column:
    """join_ministry (inline): category -> ministry, falling back to the category."""
    mmap = ministry_map or C.MINISTRY_MAP
    lookup = F.create_map(*[x for k, v in mmap.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(lookup, category), category)


def join_ministry(df: DataFrame, ministries: DataFrame, category_col: str = "category") -> DataFrame:
    """join_ministry (table form): left join on category with a user ministry table (category, ministry)."""
    dim = ministries.select(F.col("category").alias("_mcat"), F.col("ministry").alias("_min"))
    return (df.join(dim, F.col(category_col) == F.col("_mcat"), "left")
            .withColumn("ministry", F.coalesce(F.col("_min"), F.col(category_col)))
            .drop("_mcat", "_min"))


# ---------------------------------------------------------------------------
# sent_polarity / join_lexicon
# ---------------------------------------------------------------------------

def lexicon_polarity(text: Column, lexicon: Mapping[str, float] | None = None,
                     negation: str = C.NEGATION_WORD, factor: float = C.NEGATION_FACTOR) -> Column:
    """sent_polarity (inline form): mean polarity of the lexicon words in ``text``.

    Tokens are the single-space-separated words of an already cleaned text.
    A word right after ``negation`` counts ``factor`` times its value.  No
    lexicon word -> 0.0.  The membership test is a hash-set lookup (INSET);
    only the places of the few matching tokens go on to the map lookup and the
    test of the token before.
    """
    lex = dict(lexicon or C.DEFAULT_LEXICON)
    words = sorted(lex)
    # one literal, however long the lexicon: its text is parsed once, when the plan is made
    lmap = F.from_json(F.lit(json.dumps(lex)), "map<string,double>")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def mean(toks: Column) -> Column:
        hits = F.filter(F.transform(toks, lambda t, i: F.when(t.isin(*words), i)), lambda i: i.isNotNull())

        def value(i: Column) -> Column:
            v = F.try_element_at(lmap, F.get(toks, i))
            before = F.coalesce(F.get(toks, i - F.lit(1)), F.lit(""))
            return F.when(before == F.lit(negation), v * F.lit(factor)).otherwise(v)

        return F.aggregate(F.transform(hits, value), zero,
                           lambda a, v: F.when(v.isNull(), a).otherwise(
                               F.struct((a["s"] + v).alias("s"), (a["n"] + F.lit(1)).alias("n"))),
                           lambda a: F.when(a["n"] > F.lit(0), a["s"] / a["n"].cast("double")).otherwise(F.lit(0.0)))

    # an array of the one token list, so that the lambda names the tokens without splitting the text again
    toks = F.split(F.coalesce(text, F.lit("")), " ")
    return F.get(F.transform(F.array(toks), mean), F.lit(0))


def token_pairs(text: Column) -> tuple[Column, Column]:
    """(tokens, previous tokens) of a single-space separated text; the first
    token's previous token is ''."""
    toks = F.split(F.coalesce(text, F.lit("")), " ")
    prev = F.concat(F.array(F.lit("")), F.slice(toks, 1, F.greatest(F.size(toks) - F.lit(1), F.lit(0))))
    return toks, prev


def with_sentiment(df: DataFrame, polarity: Column, text_col: str, out_col: str = "_s") -> DataFrame:
    """Add sent_map(polarity) as struct column ``out_col``.

    The polarity is computed in its own projection first: sent_map refers
    to it many times, and an inlined polarity expression would be copied
    into every reference.
    """
    staged = df.withColumn("_pol", polarity)
    return S.with_sent_map(staged, F.col("_pol"), F.col(text_col), out_col).drop("_pol")


def lexicon_dim(spark, lexicon: Mapping[str, float] | None = None) -> DataFrame:
    lex = lexicon or C.DEFAULT_LEXICON
    return spark.createDataFrame([(w, float(v)) for w, v in lex.items()], "word string, polarity double")


def join_lexicon(df: DataFrame, key: str, text_col: str, lexicon: DataFrame,
                 negation: str = C.NEGATION_WORD, factor: float = C.NEGATION_FACTOR) -> DataFrame:
    """join_lexicon (table form): the tokens that pass the lexicon's Bloom filter joined with it, grouped mean.

    Returns (key, polarity) for every row of ``df``.  A group is one text of one key (key and SHA-256
    of the text, the same in every retry); rows that agree in both come back as often as they were given.
    """
    lex = lexicon.select(F.col("word"), F.col("polarity")).dropDuplicates(["word"])
    toks, prev = token_pairs(F.col(text_col))
    # (word, previous word) pairs are built inside the row, so the explode
    # needs neither a window nor a self-join.
    pairs = F.zip_with(toks, prev, lambda t, p: F.struct(t.alias("word"), p.alias("prev")))
    text = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    exploded = df.select(F.col(key), text.alias("_text"), F.posexplode(pairs).alias("_pos", "_w")).select(
        key, "_text", "_pos", F.col("_w.word").alias("word"),
        F.coalesce(F.col("_w.prev") == F.lit(negation), F.lit(False)).alias("negated"))
    # tokens that the lexicon lacks stay behind, but for the first of each text, which stands for it
    sent = where_held(exploded, F.col("word"), lex, "word", F.col("_pos") == 0)
    scored = (sent.join(lex, "word", "left")
              .withColumn("_v", F.when(F.col("negated"), F.col("polarity") * F.lit(factor)).otherwise(F.col("polarity"))))
    means = scored.groupBy(key, "_text").agg(
        F.coalesce(F.sum("_v") / F.count("_v").cast("double"), F.lit(0.0)).alias("_mean"),
        F.count_if(F.col("_pos") == F.lit(0)).cast("int").alias("_copies"))
    return means.select(key, F.explode(F.array_repeat("_mean", F.col("_copies"))).alias("polarity"))


# ---------------------------------------------------------------------------
# enr_gold
# ---------------------------------------------------------------------------

GOLD_COLUMNS = ["heading", "body_cleaned", "url", "channel", "article_date", "category",
                "positive_score", "negative_score", "neutral_score", "sentiment_label",
                "ministry", "is_negative_alert"]


def enrich_gold(silver: DataFrame, polarity: Column | None = None,
                keyword_map: Mapping[str, list[str]] | None = None,
                ministry_map: Mapping[str, str] | None = None,
                lexicon: Mapping[str, float] | None = None,
                stamp: bool = True, columns: list[str] | None = None) -> DataFrame:
    """enr_gold: silver rows -> gold rows in one projection.

    ``polarity`` may be any Column (e.g. a model hook); by default the
    inline lexicon scorer runs on ``body_cleaned``.  ``columns`` selects the
    output columns before the compute_once boundary, which carries every
    column it is given: a caller that only needs the scores names them, and
    the classifier (only ``category`` / ``ministry`` need it) is pruned away.
    """
    text = F.col("body_cleaned")
    pol = polarity if polarity is not None else lexicon_polarity(text, lexicon)
    # Stage the expensive parts in separate projections: each is referenced
    # many times by the next step, so the optimizer keeps them as computed
    # columns instead of inlining them into every reference.
    base = ["heading", "body_cleaned", "url", "channel", "article_date"]
    staged = with_category(silver.select(*base), "body_cleaned", "category", keyword_map)
    scored = with_sentiment(staged, pol, "body_cleaned")
    out = scored.select(
        *base, "category",
        F.col("_s.positive_score").alias("positive_score"),
        F.col("_s.negative_score").alias("negative_score"),
        F.col("_s.neutral_score").alias("neutral_score"),
        F.col("_s.sentiment_label").alias("sentiment_label"),
        ministry_of(F.col("category"), ministry_map).alias("ministry"),
        S.sent_alert(F.col("_s.negative_score")).alias("is_negative_alert"),
    )
    if stamp:
        out = out.withColumn("processed_at", F.current_timestamp())
    if columns is not None:
        out = out.select(*columns)
    return compute_once(out)
