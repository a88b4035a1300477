import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, fp long, shard int"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows; columns with clashing names."""
    rng = __import__("random").Random(4)
    prose = " ".join(rng.choice("the of and to stone river window quiet moves after seven".split()) + str(i % 89)
                     for i in range(400))
    long = " ".join(f"w{i % 4999}" for i in range(60_000))
    rows = [
        (1, prose, "en", "a", 1), (2, prose, "en", "a", 1), (2, prose, "en", "a", 1), (3, prose + " tail", None, "b", 1),
        (4, None, "en", "a", None), (5, "", "en", None, 0), (6, " \n\t ", "en", None, 4), (7, long, "en", "c", 9),
        (None, "no id here", "en", "a", 1), (8, "one", "en", "é", 3), (9, "one", "en", "é", 3),
        (10, "don't  stop  now　 日本語 <|endoftext|> x", "ja", "", 5), (11, prose, None, None, None),
        (12, "a b", "en", "a", 3), (None, None, None, None, None),
    ]
    return [r + (7, True, 5, 3) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
