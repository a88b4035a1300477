"""Cleaning in fewer passes gives what the passes in turn give."""

from pyspark.sql import functions as F

from presswire.functions import text as T
from presswire.operators import lemma as L


def test_one_pass_of_cleaning_equals_the_passes_in_turn(spark):
    texts = ["a1.2b It's a–b  ١٢३ x", "١áb_c 9½ ²x y", "Don’t stop—now 3rd", "", None, "ਪੰਜਾਬ १२, 'x' y\x1cz", "é É ß 1e5 #tag ok"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = T.expand_contractions(F.lower("t"))
    tokens = F.filter(F.split(F.regexp_replace(F.regexp_replace(c, T.NONWORD, " "), T.DIGITS, ""), T.WS + "+"),
                      lambda w: (F.length(w) >= 2) & ~w.isin(*T.C.SILVER_STOPWORDS))
    english = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, T.NONWORD, ""), T.NON_ASCII_ALNUM, ""), "[0-9]", "")
    punjabi = F.regexp_replace(T.native_digits(F.regexp_replace("t", T.NONWORD, "")), T.DIGITS, "")
    pairs = [(T.clean_silver(F.col("t")), F.coalesce(F.array_join(tokens, " "), F.lit(""))),
             (T.clean_english_base(F.col("t")), english), (T.clean_punjabi(F.col("t")), punjabi)]
    for r in df.select(*[x for i, (a, b) in enumerate(pairs) for x in (a.alias(f"a{i}"), b.alias(f"b{i}"))]).collect():
        assert (r.a0, r.a1, r.a2) == (r.b0, r.b1, r.b2)


def test_english_cleaning_keeps_its_two_forms_equal(spark):
    texts = ["Running cars, the mice AND not 3 geese", "", None, "a  b\u00a0c", " \n the "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lemmas in (None, {"mice": "mouse", "geese": ""}, {"mice": "small mouse", "cars": " the car "}):
        two = T.remove_stopwords_ci(L.lemmatize_inline(T.clean_english_base(F.col("t")), lemmas, T.WS + "+"), T.english_stopwords())
        for r in df.select(L.clean_english(F.col("t"), lemmas).alias("a"), two.alias("b")).collect():
            assert r.a == r.b
