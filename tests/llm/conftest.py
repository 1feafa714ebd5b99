import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls everywhere, empty and blank texts, a long one, ties, repeated rows, and columns that clash with an operator's own names.
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old river bank today again", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from the old river bank today again", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from the old river bank today again", "en", "a", 1),
    (3, None, None, None, None), (None, "text without id", "en", "b", 1), (4, "", "de", "b", 0), (5, " \n\t ", "de", "", 4), (6, LONG, "la", "c", 7), (7, "ein\n\nkurzer Text\nein", "de", None, 3), (8, None, "en", "a", None),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ROWS, DOCS)
    clash = {c: F.lit("x") for c in ("fp", "size", "h", "bucket", "score", "label", "e", "block", "kept", "quality", "component_id", "epochs", "n_words", "value", "mask", "path2")}
    return d.withColumns(clash)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
