import pytest

#: Odd documents: nulls in every column, empty and blank texts, ties, repeated rows, long texts, and what the operators look for.
LONG = " ".join(f"word{k % 977} und{k % 13}" for k in range(30_000))
PASSAGE = " ".join(f"passage{k} of{k % 7} words{k % 11}" for k in range(30))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, and then it runs away.", "en", "a", 66),
    (2, "The quick brown fox jumps over the lazy dog, and then it runs away.", "en", "b", 66),
    (2, "The quick brown fox jumps over the lazy dog, and then it runs away.", "en", "b", 66),
    (3, None, "en", "a", None),
    (None, "a text without an id, mail me at jo.doe@example.com or +1 (555) 010-9999 now", None, None, 77),
    (None, None, None, None, None),
    (4, "", "en", "", 0),
    (5, " \n\t ", "en", "c", 4),
    (6, LONG, "en", "a", len(LONG)),
    (7, "Über uns: çà et là 日本語 🙂 İstanbul ẞ", "de", "c", 35),
    (8, PASSAGE + " tail eight. Licensed under the Apache License, Version 2.0.", "en", "d", 1),
    (9, "head nine first " + PASSAGE + " GNU General Public License v3 and 10.0.0.1 and 300.1.1.1 card 4111 1111 1111 1111", "en", "d", 1),
    (10, "one", "en", "e", 3),
    (11, "Repeat me.\nRepeat me.\n\nRepeat me.\nok ok ok ok ok ok", "en", "e", 1),
    (12, 'token = "9dd3c80004c73dc9e548fee51b23b527780d4f20" and password=e3b3ed3cc8548923d6', "en", "e", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return ROWS


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = ("row", "size", "shard", "slot", "key", "fp", "h", "md5", "n_words", "target", "pos", "piece", "order", "taken", "id", "component", "start", "words", "kept", "text_crc32", "s")
    return docs.withColumns({n: F.lit(f"own {n}") for n in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    items = [(1, "quick brown fox jumps over the lazy dog and then it runs"), (2, PASSAGE), (2, PASSAGE), (3, "one"), (4, None), (5, " ,. "), (None, "lazy dog and"), (6, "日本語 🙂")]
    return spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="session")
def no_items(spark):
    return spark.createDataFrame([], "item_id long, text string")
