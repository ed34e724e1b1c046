import pytest

TEXTS = ["", None, "The cat sat on the mat.\nÀ la carte  ", "a" * 700, "Ünïcode ßtrasse 12345 don't we'll <|endoftext|> x", "word " * 9000, "x\x1cy z", "The cat sat on the mat.\nÀ la carte  "]


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, piece int")
