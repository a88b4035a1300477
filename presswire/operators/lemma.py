"""join_lemma: token -> lemma replacement (re-aim of an external lemmatiser).

Two forms: inline (a map lookup on the token array, no shuffle; for small
tables) and a join form for user tables of any size (a Bloom filter behind the
explode, an equality join of the tokens that pass, lemmas patched in by position).
The planner broadcasts the table when its bytes are below the session's threshold.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import text as T
from presswire.operators.membership import where_held

def lemma_tokens(text: Column, lemmas: Mapping[str, str] | None = None, sep: str = " ") -> Column:
    """Tokens split at ``sep`` (a pattern); each one found in the table becomes its lemma."""
    table = dict(lemmas or C.DEFAULT_LEMMAS)
    words = sorted(table)
    # one literal, however long the table
    lmap = F.from_json(F.lit(json.dumps(table)), "map<string,string>")
    toks = F.split(F.coalesce(text, F.lit("")), sep)
    return F.transform(toks, lambda t: F.when(t.isin(*words), F.try_element_at(lmap, t)).otherwise(t))


def lemmatize_inline(text: Column, lemmas: Mapping[str, str] | None = None, sep: str = " ") -> Column:
    """Tokens split at ``sep`` (a pattern), joined by a space; each one found in the table becomes its lemma."""
    return F.array_join(lemma_tokens(text, lemmas, sep), " ")


def clean_english(body: Column, lemmas: Mapping[str, str] | None = None) -> Column:
    """txt_clean_english: base cleaning, lemmas, then the stop words (all but "not").

    The tokens are joined and split again only where a lemma is more than one token.
    """
    base = T.clean_english_base(body)
    if any(c in T.WS_CHARS for lemma in (lemmas or C.DEFAULT_LEMMAS).values() for c in lemma):
        return T.remove_stopwords_ci(lemmatize_inline(base, lemmas, T.WS + "+"), T.english_stopwords())
    return T.join_kept(lemma_tokens(base, lemmas, T.WS + "+"), T.english_stopwords())


def lemma_dim(spark, lemmas: Mapping[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((lemmas or C.DEFAULT_LEMMAS).items()), "token string, lemma string")


def lemmatize_join(df: DataFrame, key: str, text_col: str, lemmas: DataFrame) -> DataFrame:
    """(key, lemmatized) for every row: lemmas are looked up by a join and patched into the text by position.

    Only tokens that pass the table's Bloom filter leave the row; the text itself goes along once.

    A group is one text of one key (key and SHA-256 of the text, the same in every retry); rows that
    agree in both are worked out once and come back as often as they were given.
    """
    dim = lemmas.select("token", "lemma").dropDuplicates(["token"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    toks = df.select(F.col(key), text.alias("_body"), F.sha2(text, 256).alias("_text")).select(
        "*", F.posexplode(F.split("_body", " ")).alias("pos", "token"))
    # tokens that the table lacks stay behind, but for the first of each text, which brings it along
    sent = where_held(toks, F.col("token"), dim, "token", F.col("pos") == 0).select(
        key, "_text", "pos", "token", F.when(F.col("pos") == 0, F.col("_body")).alias("_body"))
    found = F.when(F.col("lemma").isNotNull(), F.struct(F.col("pos"), F.lit(0).alias("own"), F.col("lemma").alias("w")))
    texts = sent.join(dim, "token", "left").groupBy(key, "_text").agg(
        F.max("_body").alias("_body"), F.collect_set(found).alias("_found"),
        F.count_if(F.col("pos") == F.lit(0)).cast("int").alias("_copies"))
    # a lemma sorts before the token of its place, and the first of a place stays
    own = F.transform(F.split("_body", " "), lambda t, i: F.struct(i.alias("pos"), F.lit(1).alias("own"), t.alias("w")))
    placed = texts.withColumn("_ws", F.sort_array(F.concat("_found", own)))
    words = F.filter("_ws", lambda x, i: (i == 0) | (F.get("_ws", i - 1)["pos"] != x["pos"]))
    lemmatized = F.array_join(F.transform(words, lambda x: x["w"]), " ")
    return placed.select(key, "_copies", lemmatized.alias("_out")).select(
        key, F.explode(F.array_repeat("_out", F.col("_copies"))).alias("lemmatized"))
