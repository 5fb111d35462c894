import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank, short and very long texts, repeated rows, ties, columns with clashing names."""
    long_text = "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich. " * 4000
    rows = [
        (1, "one two three four five six", "en", "a", 5, 1, 0.5),
        (1, "one two three four five six", "en", "a", 5, 1, 0.5),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0, 0.0),
        (4, " \n\t ", "en", None, 4, 2, 0.1),
        (5, long_text, "de", "b", len(long_text), 3, 0.2),
        (6, "word", "en", "b", 4, None, None),
        (7, "日本語 <|endoftext|> J̌ É ΑΣ 🙂 it's 123", "ja", "c", 9, 1, 1.0),
        (None, "no identifier at all", "en", "c", 20, 1, 1.0),
        (8, "one two three four five six", "en", "b", 5, 1, 0.5),
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
