"""Cleaning, keyword classification, polarity and lemma operators."""

import re

from pyspark.sql import functions as F

from presswire import constants as C
from presswire.functions import text as T
from presswire.operators import enrich as E
from presswire.operators import lemma as L


def py_clean(x):
    """The silver cleaning in plain Python (contractions from the same table)."""
    if not isinstance(x, str) or not x.strip():
        return ""
    t = x.lower()
    for w, r in C.CONTRACTIONS:
        t = re.sub(re.escape(w).replace("'", "['’]"), r, t)
    t = re.sub(r"[^\w\s]", " ", t)
    t = re.sub(r"\d+", "", t)
    t = re.sub(r"\s+", " ", t).strip()
    return " ".join(w for w in t.split() if w not in set(C.SILVER_STOPWORDS) and len(w) > 1)


SAMPLES = ["Don't STOP: the café's 42 menus!", "It's a naïve über-test_case №5 २०२४", "  ", None,
           "Edited text with separators and x² digits 7", "won’t can't shan't I'm they're"]


def test_clean_silver_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.clean_silver(F.col("t")).alias("c")).collect()}
    for i, s in enumerate(SAMPLES):
        assert got[i] == py_clean(s), (s, got[i], py_clean(s))


def test_clean_silver_matches_python_on_documents(spark, sf):
    from presswire.plans.fixtures import raw_documents
    rows = raw_documents(spark, sf).select("body", T.clean_silver(F.col("body")).alias("c")).collect()
    assert rows and all(r.c == py_clean(r.body) for r in rows)


def test_keyword_rules(spark):
    cases = [("the minister said", "Politics"),     # "ai" in "said" ties with Politics -> earlier wins
             ("he said nothing", "Technology"),      # substring hit only
             ("zzz", "Politics"),                     # zero hits
             (None, "Politics"),                      # NULL
             ("CRICKET Stadium", "Sports"),           # case-insensitive
             ("news from the us", "Politics")]       # "us " needs a trailing space
    df = spark.createDataFrame(cases, "t string, want string")
    out = E.with_category(df, "t", "got").collect()
    assert [(r.got) for r in out] == [w for _, w in cases]
    inline = df.select(E.classify_keywords(F.col("t")).alias("got")).collect()
    assert [r.got for r in inline] == [w for _, w in cases]


def test_keyword_join_equals_expression(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(
        [("wicket and court verdict", 0), ("police arrested", 0), ("nothing", 0), ("ai data cloud", 0)])],
        "k int, t string")
    a = {r.k: r.category for r in E.with_category(df, "t").collect()}
    b = {r.k: r.category for r in E.classify_keywords_join(df, "k", "t", E.keyword_dim(spark)).collect()}
    assert a == b


def test_polarity_inline_equals_join(spark):
    texts = ["good great", "not good", "terrible crisis not bad", "", "neutral words only", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    a = {r.k: r.p for r in df.select("k", E.lexicon_polarity(F.col("t")).alias("p")).collect()}
    b = {r.k: r.polarity for r in E.join_lexicon(df, "k", "t", E.lexicon_dim(spark)).collect()}
    assert a == b
    assert a[1] == C.DEFAULT_LEXICON["good"] * C.NEGATION_FACTOR
    assert a[3] == 0.0 and a[4] == 0.0


def test_lemma_inline_equals_join(spark):
    df = spark.createDataFrame([(1, "players were at matches"), (2, "people said")], "k int, t string")
    a = {r.k: r.l for r in df.select("k", L.lemmatize_inline(F.col("t")).alias("l")).collect()}
    b = {r.k: r.lemmatized for r in L.lemmatize_join(df, "k", "t", L.lemma_dim(spark)).collect()}
    assert a == b == {1: "player be at match", 2: "person say"}


def test_stopword_lists():
    assert len(C.SILVER_STOPWORDS) == 151 and "not" not in C.SILVER_STOPWORDS
    assert sum(map(len, C.KEYWORD_MAP.values())) == 190
    assert sum(map(len, C.KEYWORD_MAP_SMALL.values())) == 127


def test_text_joins_keep_repeated_rows_and_match_the_inline_forms(spark):
    rows = [(1, "good was bad"), (1, "good was bad"), (1, "not good"), (2, ""), (3, None), (4, "x" * 5000 + " great")]
    df = spark.createDataFrame(rows, "id int, t string")
    joined = sorted(map(tuple, L.lemmatize_join(df, "id", "t", L.lemma_dim(spark)).collect()))
    assert joined == sorted(map(tuple, df.select("id", L.lemmatize_inline(F.col("t"))).collect()))
    polar = sorted(map(tuple, E.join_lexicon(df, "id", "t", E.lexicon_dim(spark)).collect()))
    assert polar == sorted(map(tuple, df.select("id", E.lexicon_polarity(F.col("t"))).collect()))


def test_keyword_join_compares_no_text_with_every_keyword(spark):
    rows = [(1, "He SAID it"), (2, "abab ab"), (3, None), (4, ""), (5, "zzz"), (6, "b\nc ab")]
    words = [("A", 0, "ab"), ("A", 0, "ba"), ("B", 1, "said"), ("C", 2, "b\nc"), ("D", 3, "\nc "), ("E", 4, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    kw = spark.createDataFrame(words, "category string, rank int, keyword string")
    got = E.classify_keywords_join(df, "id", "t", kw, "none")
    assert dict(map(tuple, got.collect())) == {1: "B", 2: "A", 3: "none", 4: "none", 5: "none", 6: "A"}
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert E.classify_keywords_join(df, "id", "t", kw.limit(0), "none").where("category = 'none'").count() == 6
