"""Text joins against dictionaries of any size: Bloom filter, rarest q-gram index, patching by position."""

import random

from pyspark.sql import functions as F

from presswire.operators import enrich as E
from presswire.operators import lemma as L
from presswire.operators import membership as M


def plain_category(text, words, default):
    scores = {}
    for cat, rank, kw in words:
        if kw and kw in (text or "").lower():
            scores.setdefault((cat, rank), set()).add(kw)
    return min(((-len(v), rank, cat) for (cat, rank), v in scores.items()), default=(0, 0, default))[2]


def test_filter_loses_nothing_and_lets_little_through(spark):
    words = spark.range(3000).select(F.concat(F.lit("w"), "id").alias("word")).unionByName(
        spark.createDataFrame([(None,)], "word string"))
    assert M.where_held(words, F.col("word"), words, "word").count() == 3000
    foreign = spark.range(20_000).select(F.concat(F.lit("q"), "id").alias("t"))
    assert M.where_held(foreign, F.col("t"), words, "word").count() < 1000
    assert M.where_held(foreign, F.col("t"), words, "word", F.col("t") == "q7").where("t = 'q7'").count() == 1
    # a filter that is far too small for its dictionary only lets more through
    assert M.where_held(words, F.col("word"), words, "word", most=64).count() == 3000
    assert M.filter_bits(0) == 64 and M.filter_bits(10 ** 9) == M.MOST_BITS
    assert M.where_held(foreign, F.col("t"), words.limit(0), "word").count() == 0


def test_keywords_are_filed_under_their_rarest_gram(spark):
    rows = [(i, "the common thing and the rare zebra" if i % 40 == 0 else "the common thing") for i in range(400)]
    df = spark.createDataFrame(rows, "id int, t string")
    kw = spark.createDataFrame([("A", 0, "commonzebra"), ("B", 1, "the"), ("C", 2, "zebr")], "category string, rank int, keyword string")
    index = {r.keyword: r for r in E.gram_index(df, "t", kw).collect()}
    assert index["the"].gram == "the" and index["zebr"].gram == "zebr" and len(index) == 3
    texts = df.where(F.pmod(F.xxhash64("t"), F.lit(E.GRAM_SAMPLE)) == 0).count()
    assert index["commonzebra"].gram != "comm" or texts == 0


def test_keyword_join_equals_plain_containment(spark, monkeypatch):
    monkeypatch.setattr(E, "STRETCH", 50)
    rng = random.Random(7)
    some = "abcd é😀\n"
    words = [(f"c{i % 7}", i % 7, "".join(rng.choice(some) for _ in range(rng.randint(1, 9))).lower()) for i in range(60)]
    words += [("c0", 0, "a"), ("c9", 9, "x" * 40), ("c1", 1, "")]
    rows = [(i, "".join(rng.choice(some + "x") for _ in range(rng.randint(0, 200)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "y" * 45 + "x" * 40 + "z"), (103, "X" * 400)]
    df = spark.createDataFrame(rows, "id int, t string")
    kw = spark.createDataFrame(words, "category string, rank int, keyword string")
    got = dict(map(tuple, E.classify_keywords_join(df, "id", "t", kw, "none").collect()))
    assert got == {i: plain_category(t, words, "none") for i, t in rows}


def test_texts_send_about_as_many_rows_as_there_are_hits(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("bcdfghjklmnpqrstvwz") for _ in range(8)) for _ in range(6000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(100))) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string")
    kw = spark.createDataFrame([("A", 0, w) for w in vocab[:3000]], "category string, rank int, keyword string")
    index = E.gram_index(df, "t", kw)
    sent = E.keyword_candidates(df, "id", "t", index).where("gram is not null").count()
    hits = sum(w in set(vocab[:3000]) for _, t in rows for w in t.split())
    characters = sum(len(t) for _, t in rows)
    assert hits <= sent < 3 * hits < characters / 5
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # a table too large to broadcast: equality joins only
        plan = E.classify_keywords_join(df, "id", "t", kw)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dictionaries_beyond_the_inline_size(spark):
    lex = {f"word{i}": (i % 7 - 3) / 4 for i in range(6000)}
    texts = [(1, "word5 not word6 plain"), (2, "plain"), (3, None), (4, " ".join(f"word{i}" for i in range(0, 6000, 7)))]
    df = spark.createDataFrame(texts, "k int, t string")
    inline = {r.k: r.p for r in df.select("k", E.lexicon_polarity(F.col("t"), lex).alias("p")).collect()}
    joined = {r.k: r.polarity for r in E.join_lexicon(df, "k", "t", E.lexicon_dim(spark, lex)).collect()}
    assert {k: round(v, 9) for k, v in inline.items()} == {k: round(v, 9) for k, v in joined.items()}
    lemmas = {f"word{i}s": f"word{i}" for i in range(6000)}
    df = spark.createDataFrame([(1, "word5s are  word7s"), (2, "word5s word5s"), (2, "word5s word5s"), (3, "")], "k int, t string")
    inline = sorted(map(tuple, df.select("k", L.lemmatize_inline(F.col("t"), lemmas)).collect()))
    assert sorted(map(tuple, L.lemmatize_join(df, "k", "t", L.lemma_dim(spark, lemmas)).collect())) == inline
    many = {"c": [f"key{i}x" for i in range(3000)], "d": ["key2x"]}
    got = E.with_category(spark.createDataFrame([("a key2x key7x",), ("key2x",)], "t string"), "t", "c", many, method="expr")
    assert [r.c for r in got.orderBy("t").collect()] == ["c", "c"]


def test_foreign_tokens_are_not_shuffled(spark):
    """Of 20 000 tokens 100 are in the table: the join reads little more than these and a row for each text."""
    rows = [(i, " ".join(f"t{i * 200 + j}" for j in range(200))) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, t string")
    table = spark.createDataFrame([(f"t{i * 200 + 7}", "x") for i in range(100)], "token string, lemma string")
    toks = df.select("k", F.posexplode(F.split("t", " ")).alias("pos", "token"))
    sent = M.where_held(toks, F.col("token"), table, "token", F.col("pos") == 0)
    assert 200 <= sent.count() < 1200
    plan = sent._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]
